from pyspark.sql import functions as F

from roamspark.functions import ids, text

# line, and its skeleton by the nine rules in order
SKELETONS = [
    ("stm[1]: STA AA-BB-CC-DD-EE-FF|", "stm[]:STA|"),
    ("dead be add|", "add|"),
    ("C:\\x\\y| a=1|", "|a|"),
    ("/a/b, ok|", ",ok|"),
    ("mac aabb.ccdd.eeff|", "mac..|"),
    ("x 0x1F y|", "xy|"),
    ("ip 10.0.0.1|", "ip...|"),
    ("a b|", "ab|"),
]


def test_skeleton(spark):
    rows = spark.createDataFrame([(a,) for a, _ in SKELETONS], "c string").select("c", text.skeleton(F.col("c")).alias("s")).collect()
    assert {r.c: r.s for r in rows} == dict(SKELETONS)


def test_skeleton_ignores_digits(spark):
    df = spark.createDataFrame([("port 17 up|", "port 9 up|")], "a string, b string")
    r = df.select(text.skeleton(F.col("a")).alias("a"), text.skeleton(F.col("b")).alias("b")).first()
    assert r.a == r.b


def test_preprocess(spark):
    df = spark.createDataFrame([("  <  x >\ta  b  ",), ("",)], "c string")
    assert [r[0] for r in df.select(text.preprocess(F.col("c"))).collect()] == ["<x> a b|", "|"]


def test_standardise_text():
    assert text.standardise_text('x {"b": 1} y', ["a", "b"]) == 'x {"a":"","b":1} y'
    assert text.standardise_text('x {"k_1": 1} {bad} {"a":{"b":1}}', ["a"]) == 'x {"k_1": 1} {bad} {"a":{"b":1}}'
    assert text.standardise_text(None, ["a"]) is None


def test_keys(spark):
    df = spark.createDataFrame([('{"b":1,"a":2}',), ('{"k_1":1}',), ('{"q": oops}',), ("none",)], "c string")
    rows = df.select(F.explode(text.json_fragments(F.col("c"))).alias("f")).select(text.fragment_keys(F.col("f"))).collect()
    assert [list(r[0]) for r in rows] == [["b", "a"], [], ["q"]]


def test_ids(spark):
    values = ["AA-BB-CC-DD-EE-FF", "aabb.ccdd.eeff", "AABBCCDDEEFF", " x ", "nan", None, "dev_001234567"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(ids.normalise_mac(F.col("v")), ids.looks_like_mac(F.col("v")), ids.normalise_id(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [
        ("aa:bb:cc:dd:ee:ff", True, "aa-bb-cc-dd-ee-ff"),
        ("aa:bb:cc:dd:ee:ff", True, "aa:bb:cc:dd:ee:ff"),
        ("aa:bb:cc:dd:ee:ff", True, "aa:bb:cc:dd:ee:ff"),
        ("x", False, "x"),
        ("nan", False, ""),
        (None, False, ""),
        ("dev_001234567", False, "dev_001234567"),
    ]


def test_partial_match(spark):
    pairs = [("aa:bb", "AA:BB:CC", True), ("aa-bb-cc-dd-ee-ff", "aabb.ccdd.eeff", True), ("", "x", False), ("a", "b", False), ("..", "--", False)]
    df = spark.createDataFrame(pairs, "p string, t string, want boolean").select(ids.partial_match(F.col("p"), F.col("t")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_ratios_and_times(spark):
    df = spark.sql("select 1L a, 0L b, timestamp'2024-01-02 03:04:05' t, timestamp'2024-01-02 03:04:05.5' u")
    r = df.select(ids.safe_div(F.col("a"), F.col("b")).alias("d"), ids.f1(F.lit(0.0), F.lit(1.0)).alias("f"), ids.iso_time(F.col("t")).alias("t"), ids.iso_time(F.col("u")).alias("u")).first()
    assert (r.d, r.f, r.t, r.u) == (0.0, 0.0, "2024-01-02T03:04:05", "2024-01-02T03:04:05.500000")
    r = df.select(ids.merge_time(F.lit("2024"), F.lit("1"), F.lit("2"), F.lit("3:04:05")).alias("m")).first()
    assert str(r.m) == "2024-01-02 03:04:05"
