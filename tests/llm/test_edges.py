"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest

from roamspark.llm import compaction, decontaminate, dedup, language, minhash, packing, quality, scoring, toxicity, warc

LONG = "some long text of many words, again and again. " * 4000
ROWS = [(None, None, "en"), (1, "", None), (2, "a", "en"), (2, "a", "en"), (2, "b b", "de"), (3, LONG, "en"), (4, " \t\n ", "de"), (5, "the same line here\nthe same line here\n", "en"), (None, "no id at all", "de"), (6, "1234 ---", "en")]
CLASH = "doc_id long, text string, lang string, score string, kind string, uid string, h string, doc string, ids string, label string, _text string, c string, node string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["x"] * 10) for r in ROWS], CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def empty(df):
    return df.limit(0)


def test_dedup(docs):
    rows = dedup.dedup(docs, carry=["lang", "kind"], keep_text=True).collect()
    assert len(rows) == len(ROWS)
    got = {(r.doc_id, r.n_bytes): r for r in rows}
    assert got[(None, 0)].n_removed == 0 and got[(3, len(LONG))].n_removed > len(LONG) - 200 and got[(2, 1)].kept == "a"
    assert dedup.dedup(empty(docs)).count() == 0


def test_score(docs, spark):
    counts = scoring.token_counts(docs).persist()
    rows = scoring.score(docs, scoring.train(docs), counts).collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 and r.n_known == r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id == 1} == {1}
    none = empty(docs)
    rows = scoring.score(docs, scoring.train(none), scoring.token_counts(none)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in rows)
    assert abs(next(r.score for r in rows if r.doc_id == 1) + 8 * 0.30103) < 1e-3
    assert scoring.score(none, scoring.train(docs), counts).count() == 0


def test_packing(docs):
    rows = packing.pack(docs).collect()
    assert sum(r.start == 0 for r in rows) == len(ROWS) and {r.doc_tokens for r in rows if r.doc_id == 1} == {1}
    assert packing.pack(empty(docs)).count() == 0


def test_decontaminate(docs, spark):
    bench = spark.createDataFrame([(1, None), (None, "a"), (2, "..."), (3, "the same line here the same line here")], "item_id long, text string")
    rows = decontaminate.contamination(docs, bench, keep=["text", "kind", "c"]).collect()
    assert len(rows) == len(ROWS)
    assert [r["items"] for r in rows if r.doc_id == 2] == [[""], [""], []] and [r["items"] for r in rows if r.doc_id == 5] == [["3"]]
    assert decontaminate.contamination(empty(docs), bench).count() == 0
    assert all(not r.hits for r in decontaminate.contamination(docs, empty(bench)).collect())


def test_toxicity(docs, labels):
    for known in (labels, empty(labels)):
        rows = toxicity.score(docs, toxicity.fit(docs, known)).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty(docs), toxicity.fit(docs, labels)).count() == 0


def test_compaction(docs, spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = compaction.shard_table(docs, f"{at}/a", arrival=1, base=1, fan=2, target=64)
    assert rows.count() == len(ROWS) and set(docs.columns) <= set(rows.columns)
    assert compaction.shard_table(empty(docs), f"{at}/b").count() == 0
    with pytest.raises(ValueError):
        compaction.shard_table(docs.withColumn("run", docs.doc_id), f"{at}/c")


def test_warc(docs, spark):
    pages = docs.selectExpr("doc_id page_id", "lang url", "text html", "kind archive", "score digest")
    rows = warc.read_archives(warc.write_archives(warc.planned(pages), warc.dictionary_for(pages))).collect()
    assert len(rows) == len(ROWS) and max(r.payload_bytes for r in rows) == len(LONG)
    assert warc.read_archives(warc.write_archives(warc.planned(empty(pages)), b"")).count() == 0


def test_language(docs):
    for known in (docs, empty(docs)):
        rows = language.identify(docs, language.fit(known), keep=["text", "kind"])
        got = rows.collect()
        assert len(got) == len(ROWS)
        assert all((r.lang_pred == "und") == (known is not docs or not any(map(str.isalpha, r.text or ""))) for r in got)
    assert language.identify(empty(docs), language.fit(docs)).count() == 0


def test_minhash(docs):
    rows = minhash.near_classes(docs).collect()
    assert len(rows) == len(ROWS)
    of = {(r.doc_id): r.class_id for r in rows}
    assert of[2] == 2 and of[3] == 3 and of[1] == of[4] == 1  # texts without words are one class, whose least id is not the null one
    assert minhash.near_classes(empty(docs)).count() == 0
    assert minhash.distinct(docs, carry=["lang", "node"]).count() == len({(" ".join((r[1] or "").split())) for r in ROWS}) and minhash.distinct(empty(docs)).count() == 0


def test_quality(docs, labels):
    rows = quality.measure(docs, quality.fit(docs, labels.where("quality = 1"))).collect()
    assert len(rows) == len(ROWS) and all(r.base_failed for r in rows if r.doc_id in (1, 2, 4))
    assert quality.measure(empty(docs), quality.fit(empty(docs), empty(labels))).count() == 0


def test_pipeline(spark, docs, tmp_path):
    """Every stage takes nulls in any column, empty and long texts, ties and repeated rows, and an empty table."""
    import corpus_pipeline as cp

    sf = f"file://{tmp_path}/sf"
    spark.createDataFrame([("i1", "the same line here the same line here"), ("i2", None), (None, "")], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = [(*r, "s" if r[0] else None, len(r[1] or "") if r[0] != 2 else None) for r in ROWS]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        out = stage(spark, held, sf).collect()
        assert stage(spark, held.limit(0), sf).count() == 0
        if name == "language":
            assert all(any(map(str.isalpha, r.text or "")) for r in out)
        elif name == "near_copies":
            assert len(out) == len({" ".join((r[1] or "").split()) for r in ROWS}) and any(r.doc_id is None for r in out)
        elif name == "repeats":
            assert len(out) == len(ROWS) and all(r.n_chars == len(r.text) for r in out)
        elif name == "benchmark":
            assert len(out) == len(ROWS) - 1 and all(r.doc_id != 5 for r in out)
        else:
            assert {r.doc_id for r in out} == {r[0] for r in ROWS}
