"""Registered queries over Wi-Fi lines made from events, and SQL that each must agree with. The SQL states its patterns itself; none of it is made from the code that it checks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import consolidate, evaluate, extract, groups, header, induce, mobility, sampling, templates
from ..operators.induce import covers
from ..operators.templates import Parser
from ..session import local_table, shared_dir, staged
from ..sources import lines as sources
from ..sources import sinks
from ..streaming import stream
from . import cli, engines
from .engines import BaselineEngine, Engine

RULE = header.CATALOGUE[0]

# fixed values: the literal parsers of the made lines
_PARSERS = [
    ("stm[]:Assocsuccess:STA:::::APssidcampus|", 1, ("client_mac", "ap_name"), r"\Astm\[.*?\]: Assoc success: STA (.*?) AP (.*?) ssid=.*?\|\z"),
    ("stm[]:Authrequest:STA:::::AP...|", 1, ("client_mac", "ap_ip"), r"\Astm\[.*?\]: Auth request: STA (.*?) AP (.*?)\|\z"),
    ("stm[]:Deauthfromsta:::::::APReasonSTAhasleft|", -1, ("client_mac", "ap_name"), r"\Astm\[.*?\]: Deauth from sta: (.*?): AP (.*?) Reason STA has left\|\z"),
    ('stm[]:Disassocclient:::::apinfo{"k":}|', -1, ("client_mac", "ap_name"), r"\Astm\[.*?\]: Disassoc client=(.*?) ap=(.*?) info=.*?\|\z"),
    ("dhcpd:DHCPACKon...to:::::via|", 0, (), r"\Adhcpd: DHCPACK on .*? to .*? via .*?\|\z"),
]


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a scan dealt to all cores where it has fewer parts, as what follows costs far more than a shuffle of its input; larger inputs stay as they are read."""
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(parallel) if rows.rdd.getNumPartitions() < parallel else rows


def wifi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    i, u = F.col("event_id"), F.col("user_id")
    mac = F.concat(F.lit("02:00:00:00:"), two(F.floor(u / 100)), F.lit(":"), two(u % 100))
    ap = F.concat(F.lit("AP-B"), i % 12, F.lit("-F"), i % 4)
    content = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("stm[3456]: Assoc success: STA "), mac, F.lit(" AP "), ap, F.lit(" ssid=campus")))
        .when(F.col("event_type") == "click", F.concat(F.lit("stm[3456]: Auth request: STA "), mac, F.lit(" AP 10.1."), i % 12, F.lit("."), i % 4))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("stm[3456]: Deauth from sta: "), mac, F.lit(": AP "), ap, F.lit(" Reason STA has left")))
        .when(F.col("event_type") == "error", F.concat(F.lit("stm[3456]: Disassoc  client="), mac, F.lit(" ap="), ap, F.lit(" info="), F.col("props")))
        .otherwise(F.concat(F.lit("dhcpd: DHCPACK on 10.2."), u % 12, F.lit("."), i % 250, F.lit(" to "), mac, F.lit(" via /var/run/eth0.log")))
    )
    return e.select(i.alias("line_index"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), content).alias("raw"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.parsed_lines(wifi_lines(spark, sf_dir), RULE)


def again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parsed(), staged, for queries that read it several times."""
    return staged(parsed(spark, sf_dir), "parsed")


def table(spark: SparkSession, most: int = 5) -> DataFrame:
    held = _PARSERS[:most]
    return extract.parser_table(spark, {s: k for k, (s, *_) in enumerate(held)}, {k: Parser(p, n, f) for k, (_, f, n, p) in enumerate(held)})


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.records(parsed(spark, sf_dir), table(spark))


def stamp(ts: Column | str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("ts")


def truth(records: DataFrame) -> DataFrame:
    """Ground truth as a CSV would hold it: some rows missing, some actions flipped, some MACs with dashes."""
    rows = records.where("line_index % 17 <> 0")
    flipped = F.when((F.col("event") == "connect") == (F.col("line_index") % 13 == 0), F.lit("disconnect")).otherwise(F.lit("connect"))
    client = F.when(F.col("line_index") % 5 == 0, F.translate("client_id", ":", "-")).otherwise(F.col("client_id"))
    return rows.select(F.col("line_index").cast("string").alias("OriginalLineIdx"), stamp().alias("DateTime"), flipped.alias("Action"), F.col("ap_id").alias("ApId"), F.lit("").alias("BSSID"), client.alias("ClientId"))


def mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, raw = F.col("line_index"), F.col("raw")
    odd = F.when(i % 37 == 0, F.substr(raw, F.lit(21))).when(i % 41 == 0, F.concat(F.repeat(F.lit("x"), F.lit(250)), raw)).when(i % 43 == 0, F.concat(F.lit("2024-13-45 00:00:00 "), F.substr(raw, F.lit(21)))).when(i % 47 == 0, F.substr(raw, F.lit(1), F.lit(19)))
    return wifi_lines(spark, sf_dir).select("line_index", odd.otherwise(raw).alias("raw"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", F.col("n").cast("long").alias("n"), text.skeleton(F.col("line"), ascii_only=True).alias("skeleton"))


def ids_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = found(spark, sf_dir).select("line_index", "client_id", "ap_id")
    i, c = F.col("line_index"), F.col("client_id")
    form = F.when(i % 6 == 0, F.translate(c, ":", "-")).when(i % 6 == 1, F.translate(c, ":", "")).when(i % 6 == 2, F.concat_ws(".", F.substr(F.translate(c, ":", ""), F.lit(1), F.lit(4)), F.substr(F.translate(c, ":", ""), F.lit(5), F.lit(4)), F.substr(F.translate(c, ":", ""), F.lit(9), F.lit(4)))).when(i % 6 == 3, F.concat(F.lit("  "), F.upper(F.col("ap_id")), F.lit(" "))).when(i % 6 == 4, F.lit("NaN")).otherwise(c)
    return r.select("line_index", form.alias("value"), "client_id", "ap_id")


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = header.split_header(mutated(spark, sf_dir), RULE)
    rows = groups.kept(split).withColumn("content", text.preprocess(F.col("content"))).withColumn("skeleton", text.skeleton(F.col("content")))
    small = rows.groupBy("skeleton").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") < 100).alias("too_small"))
    return split.agg(F.count("*").alias("lines"), F.count_if(F.col("status") == "success").alias("lines_kept")).crossJoin(small)


def coverage_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = again(spark, sf_dir)
    parsers = local_table(spark, [(k, p) for k, (*_, p) in enumerate(_PARSERS)] + [(9, r"\Astm\[.*?\]: .*\|\z")], "parser_id int, pattern string")
    return groups.group_sample(rows, order=F.col("line_index")), groups.micro_groups(rows), parsers


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who speaks for each skeleton once a wide parser of the largest group has absorbed what it covers."""
    samples, found_groups, _ = coverage_inputs(spark, sf_dir)
    held = [r.asDict() for r in found_groups.collect()]
    lines: dict[str, list[str]] = {}
    for r in samples.orderBy("line_index").collect():
        lines.setdefault(r.skeleton, []).append(r.content)
    for g in held:
        g["sample"] = lines[g["skeleton"]]
    wide = Parser(r"\Astm\[.*?\]: .*\|\z", (), 1)
    run = consolidate.induce_all(held, 1, lambda g: wide if g["skeleton"].startswith("stm") else Parser(None, (), 0), covers)
    first = min((g for g in held if g["skeleton"].startswith("stm")), key=lambda g: (-g["n"], g["first_idx"]))["skeleton"]
    by_id = {g["group_id"]: g["skeleton"] for g in held}
    assert by_id[run.canon[first]] == first
    return local_table(spark, [(s, by_id[c], c in run.parsers and run.parsers[c].pattern is not None) for s, c in run.canon.items()], "skeleton string, canonical string, parsed boolean")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "stream")
    wifi_lines(spark, sf_dir).write.parquet(f"{root}/in")
    rows = stream.stream_records(spark.readStream.schema("line_index long, raw string").parquet(f"{root}/in"), RULE, table(spark))
    stream.to_parquet(rows.select("line_index", "ts", "ap_id", "client_id", "event", "flag"), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema("line_index long, ts timestamp, ap_id string, client_id string, event string, flag int").parquet(f"{root}/out").select("line_index", stamp(), "ap_id", "client_id", "event", "flag")


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts of a stream; a last line long after the others closes all their windows."""
    root = _folder(spark, "counts")
    late = local_table(spark, [(-1, "2030-01-01 00:00:00 stm[3456]: Auth request: STA 02:00:00:00:00:00 AP 10.1.0.0")], "line_index long, raw string")
    wifi_lines(spark, sf_dir).coalesce(1).write.parquet(f"{root}/in")
    late.write.mode("append").parquet(f"{root}/in")
    lines = spark.readStream.schema("line_index long, raw string").parquet(f"{root}/in")
    counts = stream.windowed_counts(stream.stream_records(lines, RULE, table(spark)))
    stream.to_parquet(counts, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema("start timestamp, ap_id string, event string, n long").parquet(f"{root}/out").select(stamp("start").alias("start"), "ap_id", "event", "n")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def log_file(spark: SparkSession, lines: DataFrame) -> str:
    """A folder of text files that hold lines in their order."""
    at = _folder(spark, "log")
    lines.orderBy("line_index").select("raw").write.text(at)
    return at


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with marks of other line ends in them, trailing returns, blank ones, and the replacement character."""
    i, raw = F.col("line_index"), F.col("raw")
    odd = F.when(i % 11 == 0, F.concat(raw, F.lit("\x0bmore\u2028and more"))).when(i % 13 == 0, F.concat(raw, F.lit("\r"))).when(i % 17 == 0, F.lit("")).when(i % 19 == 0, F.concat(raw, F.lit(" \ufffd")))
    return wifi_lines(spark, sf_dir).select("line_index", odd.otherwise(raw).alias("raw"))


def truth_file(spark: SparkSession, rows: DataFrame) -> str:
    at = _folder(spark, "truth")
    rows.orderBy(F.col("OriginalLineIdx").cast("long")).write.option("header", True).option("emptyValue", "").csv(at)
    return at


def scored(spark: SparkSession, sf_dir: str, score: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A score of line events and records against the truth, all from one scan of the lines."""
    lines = again(spark, sf_dir)
    records = staged(extract.records(lines, table(spark)), "records")
    return _metrics(score(extract.line_events(lines, table(spark)), records, truth(records)))


def doubled(rows: DataFrame) -> DataFrame:
    """Truth in which a line number repeats."""
    return rows.unionByName(rows.where("OriginalLineIdx = '1'"))


class Patterns:
    """A baseline inducer of one raw pattern for each kind of line."""

    def parser(self, lines: list[str], examples: list) -> tuple[str | None, int]:
        for word, regex, flag in (("Assoc", r"stm.*STA (?P<client_mac>\S+) AP (?P<ap_name>\S+)", 1), ("Auth", r"stm.*STA (?P<client_mac>\S+) AP (?P<ap_ip>[\d.]+)", 1), ("Deauth", r"stm.*sta: (?P<client_mac>\S+): AP (?P<ap_name>\S+)", -1), ("Disassoc", r"stm.*client=(?P<client_mac>\S+) ap=(?P<ap_name>\S+)", -1)):
            if f" {word} " in lines[0]:
                return regex, flag
        return None, 0

    def repair(self, lines: list[str], regex: str, failed: str, info: str) -> list[str]:
        return []


def _outgoing(rows: DataFrame) -> DataFrame:
    return rows.select("line_index", stamp(), "ap_id", "client_id", "event", "flag")


def engine_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outgoing(Engine(spark).process_file(log_file(spark, wifi_lines(spark, sf_dir))).records)


def engine_of_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the caller hands over one after another, of which the driver holds a part of 100,000 at a time."""
    lines = wifi_lines(spark, sf_dir).select("line_index", "raw")
    parts = lines.repartitionByRange(lines.count() // 100_000 + 1, "line_index").sortWithinPartitions("line_index")
    return _outgoing(Engine(spark).process_logs(r.raw for r in parts.toLocalIterator()).records)


def baseline_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outgoing(BaselineEngine(spark, inducer=Patterns()).process_file(log_file(spark, wifi_lines(spark, sf_dir))).records)


def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place and size of the batches that a callback is given."""
    sizes: list[int] = []
    Engine(spark).process_file_stream(log_file(spark, wifi_lines(spark, sf_dir)), lambda rows: sizes.append(len(rows)), 700)
    return local_table(spark, list(enumerate(sizes)), "batch long, n long")


def experiment(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Runs a configuration of two datasets as the command line does; the output folder, and the first dataset's."""
    lines = again(spark, sf_dir)
    gt = truth_file(spark, truth(extract.records(lines, table(spark))))
    log, out = log_file(spark, wifi_lines(spark, sf_dir)), _folder(spark, "outputs")
    held = {"datasets": [{"name": "by_line", "log_path": log, "gt_path": gt}, {"name": "by_record", "log_path": log, "gt_path": gt, "matching": "record", "exclude_client_in_fea": True}, {"name": "unused", "log_path": "nowhere"}]}
    sinks.write_json(spark, held, f"{out}/config.json")
    cli.run(spark, f"{out}/config.json", out, ["by_line", "by_record"], run_id="run")
    return f"{out}/run", f"{out}/run/by_line"


SCORES = ["event_precision", "event_recall", "event_f1", "field_extraction_accuracy"]


def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(f"{experiment(spark, sf_dir)[0]}/summary_main.csv")
    return rows.select("dataset", "matching", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in SCORES], *[F.col(c).cast("long").alias(c) for c in ("event_tp", "event_fp", "event_fn", "field_tp", "gt_events", "pred_events", "lines", "groups", "records")])


def records_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "ap_id string, client_id string, timestamp string, event string, raw_log string, metadata struct<connect_flag:int, cluster_id:int, line_index:long, timestamp_source:string>"
    return spark.read.schema(schema).json(f"{experiment(spark, sf_dir)[1]}/records.jsonl").select("ap_id", "client_id", "timestamp", "event", "raw_log", F.col("metadata.line_index").alias("line_index"), F.col("metadata.connect_flag").alias("connect_flag"), F.col("metadata.timestamp_source").alias("source"))


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics, metrics and the bundle that a run leaves."""
    out, one = experiment(spark, sf_dir)
    read = lambda at, *c: spark.read.option("multiLine", True).json(at).select(*c)
    stats = read(f"{one}/stats.json", F.col("lines").alias("lines"), F.col("lines_kept").alias("lines_kept"))
    found = read(f"{one}/metrics.json", F.col("event_tp").alias("event_tp"))
    bundle = read(f"{out}/summary_main.json", F.size("results").cast("long").alias("datasets"))
    return stats.crossJoin(found).crossJoin(bundle)  # one row each


def catalogue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's time in the form of one of the catalogue's rules, by line number."""
    rows = wifi_lines(spark, sf_dir).select("line_index", F.to_timestamp(F.substring("raw", 1, 19)).alias("t"))
    out = None
    for k, (day, rule) in enumerate(zip(["yyyy-MM-dd'T'HH:mm:ss", "yyyy/M/d H:mm:ss", "M/d/yyyy H:mm:ss", "'date='yyyy-MM-dd' time='HH:mm:ss", "MMM d yyyy HH:mm:ss", "MMM  d HH:mm:ss", "d MMM yyyy HH:mm:ss"], header.CATALOGUE)):
        made = rows.where(F.col("line_index") % len(header.CATALOGUE) == k).select("line_index", F.concat(F.lit("<14> "), F.date_format("t", day), F.lit("] up")).alias("raw"))
        got = header.split_header(made, rule).select("line_index", stamp(), "content")
        out = got if out is None else out.unionByName(got)
    return out


# fixed values: lines that try the edges of the header, of clean-up and of the skeleton
TRICKY = [
    "", "   ", "\t2024-01-01 00:00:01\tab\t c \t", "[2024-01-01 00:00:02] x", "2024-01-01 00:00:03", "2024-01-01 00:00:04 , |-:\" ", "x" * 201 + " 2024-01-01 00:00:05 far", "2024-02-30 00:00:06 bad day",
    "\x02 no header", "2024-01-01 00:00:07 a\x01b\x02c", "\x01 2024-01-01 00:00:08 after", "2024-01-01 00:00:09 a < b <c >", "2024-01-01 00:00:10 <  >x< y>", "2024-01-01 00:00:11 no\u00a0break\u2003space",
    "2024-01-01 00:00:12 see foo.config and www.a-b.com/x", "2024-01-01 00:00:13 dead be add AA-BB-CC-DD-EE-FF aabb.ccdd.eeff", "2024-01-01 00:00:14 C:\\x\\y| /a/b, ok 0x1F", "2024-01-01 00:00:15 {\"a\":1,\"b_1\":2} {\"n\":{\"m\":1}}",
    "2024-01-01 00:00:16 ap_mac=dev_001234567", "2024-01-01 00:00:17 \u0663 digits \u00e9t\u00e9", "2024-01-01 00:00:18 \ufffd kept",
]
# fixed values: status, time, content and skeleton of each, worked out by hand
TRICKY_WANT = [
    ("no_match", None, None, None), ("no_match", None, None, None), ("success", "01", "ab c|", "c|"), ("success", "02", "] x|", "]x|"), ("empty_content", "03", None, None), ("empty_content", "04", None, None), ("ts_too_far", None, None, None), ("parse_failed", None, None, None),
    ("no_match", None, None, None), ("success", "07", "a\x01b\x02c|", "a\x01b\x02c|"), ("success", "08", "after|", "after|"), ("success", "09", "a < b <c>|", "a<b<c>|"), ("success", "10", "<>x<y>|", "<>x<y>|"), ("success", "11", "no\u00a0break\u2003space|", "nobreakspace|"),
    ("success", "12", "see foo.config and www.a-b.com/x|", "seenfigand|"), ("success", "13", "dead be add AA-BB-CC-DD-EE-FF aabb.ccdd.eeff|", "add..|"), ("success", "14", "C:\\x\\y| /a/b, ok 0x1F|", "|,ok|"), ("success", "15", "{\"a\":1,\"b_1\":2} {\"n\":{\"m\":1}}|", "{\"a\":,\"b_\":}{\"n\":{\"m\":}}|"),
    ("success", "16", "ap_mac=dev_001234567|", "ap_macdev_|"), ("success", "17", "\u0663 digits \u00e9t\u00e9|", "digits\u00e9t\u00e9|"), ("success", "18", "\ufffd kept|", "\ufffdkept|"),
]


def tricky(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = header.split_header(sources.lines_of(spark, TRICKY), RULE)
    content = F.when(F.col("status") == "success", text.preprocess(F.col("content")))
    return split.select("line_index", "status", F.date_format("ts", "ss").alias("second"), content.alias("content"), F.when(F.col("status") == "success", text.skeleton(content)).alias("skeleton"))


# fixed values: replies of models and templates, and what they say
REPLIES = [
    ('{"template": "a {{ap_name}}|", "connect_flag": 1}', "a {{ap_name}}|", 1), ('so:\n```json\n{"template": "x", "connect_flag": "-1"}\n```', "x", -1), ('{bad} {"template": " ", "connect_flag": 1.5}', None, 0), ("none", None, 0),
]
TEMPLATES = [("AP {{ap_name}} (x) {{client_mac_1}}|", r"AP (.*?) \(x\) (.*?)\|", "ap_name,client_mac_1"), ("{{ssid}}.{{ap_name}}{{ap_name}}", r".*?\.(.*?)(.*?)", "ap_name,ap_name")]
PYTHON_REGEXES = [(r"\Aa(?P<x>[]b]+)\Z", r"(?Ud)\Aa([\]b]+)\z", "x"), (r"(a)(?P<y>.)(?P=y)", r"(?Ud)(?:a)(.)\1", "y"), ("(", None, None)]


def induction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies, templates and patterns of models as the induction reads them."""
    rows = [("reply", k, *(str(v) if v is not None else None for v in templates.template_reply(r))) for k, (r, _, _) in enumerate(REPLIES)]
    rows += [("regex reply", 0, *map(str, templates.regex_reply('{"regex": "a\\d", "connect_flag": 1}')))]
    rows += [("template", k, p.removeprefix(r"(?d)\A").removesuffix(r"\z"), ",".join(n)) for k, (t, _, _) in enumerate(TEMPLATES) for p, n in [templates.compile_template(t)]]
    rows += [("pattern", k, *((t[0], ",".join(t[1])) if (t := templates.translate(r)) else (None, None))) for k, (r, _, _) in enumerate(PYTHON_REGEXES)]
    rows += [("anchored", k, templates.anchored(r), None) for k, r in enumerate(["a", "^a", r"\Aa$"])]
    rows += [("validated", k, str(ok), kind or (failed or "")) for k, (ok, failed, _, kind) in enumerate(induce.validate(p, lines) for p, lines in [("a.", ["ab", "ac"]), ("(", ["a"]), ("", ["a"]), ("ab", ["ab", "xy"])])]
    rows += [("located", 0, induce.locate(r"stm (\w+) AP (\d+)", "stm up AP x"), None), ("captured", 0, json.dumps(induce.captures(r"AP (?P<ap>\S+)(?P<no>z)?", "an  AP   a1")), None)]
    rows += [("repair sample", 0, ",".join(sampling.repair_sample(["a", "b", "a", "c", "d", "e", "f"], "c")), None), ("similar", 0, ",".join(sampling.sample(["up one", "up two", "down far off"], 3, "similar")), None)]
    usage = induce.Chat(lambda m: '{"regex": "x", "connect_flag": -1}', "regex", (lambda m: '{"regex": "y"}', lambda m: "none"))
    said = [str(usage.parser(["l"], [])), ",".join(usage.repair(["l"], "x", "l", "why"))]
    rows += [("asked", k, v, None) for k, v in enumerate([*said, str(usage.usage.calls), ",".join(sorted(usage.usage.by_model))])]
    rows += [("tokens", 0, str(induce.message_tokens([{"role": "user", "content": "abcdefgh"}])), None)]
    return local_table(spark, rows, "kind string, place long, found string, more string")


def header_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rules of replies, settings of a configuration, and what a model that mends its rule is told."""
    reply = {"regex": RULE.regex, "date_format": RULE.date_format, "time_format": RULE.time_format}
    told: list[str] = []

    def ask(messages: list[dict]) -> str:
        told.append(messages[-1]["content"])
        return ["not JSON", json.dumps({**reply, "regex": r"(?P<date>\d{9})(?P<time>\d)"}), "so: " + json.dumps(reply)][len(told) - 1]

    lines = staged(sources.sample_lines(wifi_lines(spark, sf_dir)), "first")
    found = header.infer(lines, induce.Chat(ask).header)
    missing = 0
    for name in reply:
        try:
            header.HeaderRule.from_reply({k: v for k, v in reply.items() if k != name})
        except ValueError:
            missing += 1
    config = {"llm": {"primary_model": "a", "base_url": "u", "fallback_models": "b, c", "request_timeout_seconds": "0.2", "max_retries": "x", "disable_fallback": "yes"}}
    held = sources.Settings.load(config, {"ROAMSPARK_MODEL": "m"})
    rows = [("inferred", found.regex), ("catalogue", header.infer(lines).regex), ("asked", str(len(told))), ("told", str("no_match" in told[2] and "Outcomes" in told[2])), ("missing", str(missing))]
    rows += [("json", json.dumps(header.json_in('x {"a": {"b": 1}} y'))), ("none", str(header.json_in("x } {")))]
    rows += [(k, str(getattr(held, k))) for k in ("primary_model", "base_url", "fallback_models", "request_timeout_seconds", "max_retries", "disable_fallback", "batch_size")]
    legacy = header.DateRule.build(["", "on 2024-05-06 up"], lambda m: json.dumps({"regex": r"on (?P<ts>\S+)", "format": "%Y-%m-%d"}))
    return local_table(spark, [*rows, ("legacy", str(legacy.parse("on 2024-05-06 up"))), ("names", ",".join(d.name for d in sources.Experiment.of({"datasets": [{"name": n, "log_path": "x"} for n in "abc"]}, ["c", "a"]).datasets))], "name string, value string")


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times from their parts, from text and in a zone, and sizes of messages."""
    rows = wifi_lines(spark, sf_dir).select("line_index", F.substring("raw", 1, 19).alias("t"))
    part = lambda a, n: F.substring("t", a, n)
    merged = ids.merge_time(part(1, 4), part(6, 2), part(9, 2), F.concat(part(12, 2), F.lit(":"), part(15, 2)), second=None)
    second = ids.merge_time(part(1, 4), part(6, 2), part(9, 2), part(12, 2), minute=part(15, 2))
    whole = ids.merge_time(timestamp=F.col("t"))
    read = ids.parse_time(F.when(F.col("line_index") % 2 == 0, F.translate("t", "-:", "")).otherwise(F.col("t")))
    return rows.select("line_index", stamp(merged).alias("merged"), stamp(second).alias("joined"), stamp(whole).alias("whole"), stamp(read).alias("read"), F.date_format(ids.naive_utc(F.to_timestamp("t"), "Etc/GMT-2"), "yyyy-MM-dd HH:mm:ss").alias("utc"), ids.token_estimate(F.lit("user"), F.col("t")).cast("long").alias("tokens"))


def engine_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    try:
        engines.get_engine_name("other")
    except ValueError as why:
        told = str(why)
    return local_table(spark, [(n, n == engines.get_engine_name(None), n in told) for n in engines.list_supported_engines()], "name string, standard boolean, told boolean")


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What callers are told of ten steps, four a second."""
    seen: list[dict] = []
    clock: Iterator[float] = iter(k / 4 for k in range(1000))
    tell = sinks.Progress(seen.append, lambda: next(clock), 50)
    for k in range(1, 11):
        tell("scan", k / 10, lines_processed=k * 30)
    return local_table(spark, [(k, round(x["file_fraction"], 6), x["chunk_index"], x["chunk_fill"]) for k, x in enumerate(seen)], "place long, fraction double, chunk long, fill long")


def engine_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default engine with the offline inducer, from raw lines to records."""
    return Engine(spark).process(wifi_lines(spark, sf_dir)).records.select("line_index", stamp(), "ap_id", "client_id", "event", "flag")


def _metrics(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    q["records_by_ap"] = lambda s, d: found(s, d).groupBy("ap_id", "event").agg(F.count("*").alias("n"))
    q["lines_clean"] = lambda s, d: wifi_lines(s, d).select("line_index", header.normalised(F.concat(F.lit("\t "), F.col("raw"), F.lit(" \t"))).alias("line"))
    q["sample_lines"] = lambda s, d: sources.sample_lines(wifi_lines(s, d), 500).select("line_index", "raw")
    q["strided_lines"] = lambda s, d: sources.strided(wifi_lines(s, d), 100).select("line_index", "raw")
    q["chunk_labels"] = lambda s, d: sources.chunk_of(wifi_lines(s, d), 500).groupBy("chunk").agg(F.max("fill").alias("fill"))
    q["header_split"] = lambda s, d: header.split_header(wifi_lines(s, d), RULE).select("line_index", stamp(), "content")
    q["header_report"] = lambda s, d: header.report(header.split_header(mutated(s, d), RULE)).select("status", "n", F.array_join("examples", "\n").alias("examples"))
    q["preprocess"] = lambda s, d: parsed(s, d).select("line_index", "content")
    q["skeleton"] = lambda s, d: parsed(s, d).select("line_index", "skeleton")
    q["micro_groups"] = lambda s, d: groups.micro_groups(parsed(s, d)).select("skeleton", "n", "first_idx", "representative", F.col("group_id").cast("long").alias("group_id"))
    q["micro_group_sample"] = lambda s, d: groups.group_sample(parsed(s, d), order=F.col("line_index")).select("skeleton", "line_index")
    q["eligible_groups"] = lambda s, d: groups.eligible(groups.micro_groups(parsed(s, d)), 2000).select("skeleton", "n")
    q["groups_by_size"] = lambda s, d: groups.micro_groups(parsed(s, d)).select("skeleton", F.row_number().over(Window.orderBy(F.desc("n"), "first_idx")).cast("long").alias("place"))
    q["merged_groups"] = lambda s, d: _merged(again(s, d))
    q["distinct_lines"] = lambda s, d: groups.distinct_in_order(parsed(s, d))
    q["json_keys"] = lambda s, d: groups.key_rows(parsed(s, d)).distinct()
    q["json_standard"] = lambda s, d: parsed(s, d).where(F.col("content").contains("{")).select("line_index", text.standardise(F.col("content"), ["a", "k"]).alias("content"))
    q["fields"] = lambda s, d: extract.with_fields(parsed(s, d), table(s)).select("line_index", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("client_mac", "ap_name", "ap_ip")])
    q["wifi_records"] = lambda s, d: found(s, d).select("line_index", stamp(), "ap_id", "client_id", "event", "flag")
    q["record_payload"] = lambda s, d: extract.payload(found(s, d)).select("ap_id", "client_id", "timestamp", "event", F.col("metadata.line_index").alias("line_index"), F.col("metadata.connect_flag").alias("connect_flag"))
    q["line_events"] = lambda s, d: extract.line_events(parsed(s, d), table(s)).select("line_index", stamp(), "event")
    q["cache_stats"] = lambda s, d: extract.lookup_stats(parsed(s, d), table(s, 4)).select("hits", "misses", "patterns", "total", F.round("hit_rate", 6).alias("hit_rate"))
    q["mac_norm"] = lambda s, d: ids_made(s, d).select("line_index", ids.normalise_mac(F.col("value")).alias("mac"), ids.looks_like_mac(F.col("value")).alias("is_mac"))
    q["id_norm"] = lambda s, d: ids_made(s, d).select("line_index", ids.normalise_id(F.col("value")).alias("id"), ids.compact(F.col("value")).alias("token"))
    q["event_norm"] = lambda s, d: wifi_lines(s, d).select("line_index", ids.normalise_event(F.element_at(F.array(*map(F.lit, ["Connect ", "1", "+1", "-1", "DISCONNECT", "0", "x"])), (F.col("line_index") % 7 + 1).cast("int"))).alias("event"))
    q["time_norm"] = lambda s, d: found(s, d).select("line_index", ids.normalise_time(F.when(F.col("line_index") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("line_index") % 3 == 1, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise("soon")).alias("ts"))
    q["partial_match"] = lambda s, d: ids_made(s, d).select("line_index", ids.partial_match(F.col("value"), F.col("client_id")).alias("client"), ids.partial_match(F.col("value"), F.col("ap_id")).alias("ap"))
    q["coverage_matrix"] = lambda s, d: consolidate.coverage(*coverage_inputs(s, d))
    q["consolidated_groups"] = consolidated
    q["eval_line_index"] = lambda s, d: scored(s, d, lambda e, r, t: evaluate.by_line(e, r, t, 1 << 40))
    q["eval_no_client"] = lambda s, d: scored(s, d, lambda e, r, t: evaluate.by_line(e, r, t, 700, False))
    q["eval_repeated"] = lambda s, d: scored(s, d, lambda e, r, t: evaluate.evaluate(e, r, doubled(t), 1 << 40, note=lambda why: None)).select("matching", "event_tp", "event_fp", "event_fn", "gt_events", "pred_events")
    q["eval_record_events"] = lambda s, d: scored(s, d, lambda e, r, t: evaluate.event_counts(e, evaluate.truth_by_record(t))).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))
    q["eval_record"] = lambda s, d: scored(s, d, lambda e, r, t: evaluate.by_record(e, r, t))
    q["eval_record_extracted"] = lambda s, d: scored(s, d, lambda e, r, t: evaluate.by_record(e, r.where("line_index % 7 <> 0"), t, False, True))
    q["events_common"] = lambda s, d: scored(s, d, lambda e, r, t: e.select("line_index", "event").intersect(evaluate.truth_by_line(t, 1 << 40).select("line_index", "event")))
    q["events_only_predicted"] = lambda s, d: scored(s, d, lambda e, r, t: e.select("line_index", "event").exceptAll(evaluate.truth_by_line(t, 1 << 40).select("line_index", "event")))
    q["run_stats"] = scan_stats
    q["diverse_sample"] = lambda s, d: sampling.sampled_groups(groups.group_sample(parsed(s, d), order=F.col("line_index")), 8)
    q["random_sample"] = lambda s, d: sampling.sampled_groups(groups.group_sample(parsed(s, d), order=F.col("line_index")), 8, "random")
    q["kmeans_batches"] = lambda s, d: sampling.batches(groups.group_sample(parsed(s, d), order=F.col("line_index")), 16)
    q["ap_transitions"] = lambda s, d: mobility.transitions(found(s, d))
    q["ap_hotspots"] = lambda s, d: mobility.hotspots(found(s, d))
    q["doc_skeletons"] = lambda s, d: document_lines(s, d)
    q["doc_dupe_groups"] = lambda s, d: document_lines(s, d).groupBy("skeleton").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("n > 1")
    q["stream_records"] = streamed
    q["engine_records"] = engine_records
    q["stream_counts"] = streamed_counts
    q["file_lines"] = lambda s, d: sources.read_lines(s, log_file(s, marked(s, d)))
    q["whole_lines"] = lambda s, d: sources.read_whole(s, log_file(s, marked(s, d)))
    q["line_count"] = lambda s, d: local_table(s, [(sources.count_lines(sources.read_lines(s, log_file(s, marked(s, d)))),)], "n long")
    q["truth_rows"] = lambda s, d: sources.read_ground_truth(s, truth_file(s, truth(found(s, d)))).select("OriginalLineIdx", "DateTime", "Action", "ApId", "BSSID", "ClientId")
    q["engine_file_records"], q["engine_log_records"], q["baseline_records"] = engine_of_file, engine_of_logs, baseline_of_file
    q["batch_sizes"], q["summary_file"], q["records_file"], q["json_files"] = batch_sizes, summary_file, records_file, json_files
    q["catalogue_times"], q["tricky_lines"], q["induction_texts"], q["times"] = catalogue_lines, tricky, induction_texts, times
    q["engine_names"], q["progress_events"], q["header_texts"] = engine_names, progress_events, header_texts
    return q


def _merged(rows: DataFrame) -> DataFrame:
    halves = [staged(groups.micro_groups(rows.where(F.col("line_index") % 2 == k)), "half") for k in (0, 1)]
    return groups.merge_groups(*halves).select("skeleton", "n", "first_idx", "representative", "group_id")


# ---- SQL ----

_LINES = """ev AS (SELECT event_id AS i, ts, user_id AS u, event_type, props,
  '02:00:00:00:' || lpad(CAST(user_id // 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') AS mac, 'AP-B' || (event_id % 12) || '-F' || (event_id % 4) AS ap FROM events),
lines AS (SELECT i AS line_index, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type
  WHEN 'signup' THEN 'stm[3456]: Assoc success: STA ' || mac || ' AP ' || ap || ' ssid=campus'
  WHEN 'click' THEN 'stm[3456]: Auth request: STA ' || mac || ' AP 10.1.' || (i % 12) || '.' || (i % 4)
  WHEN 'purchase' THEN 'stm[3456]: Deauth from sta: ' || mac || ': AP ' || ap || ' Reason STA has left'
  WHEN 'error' THEN 'stm[3456]: Disassoc  client=' || mac || ' ap=' || ap || ' info=' || props
  ELSE 'dhcpd: DHCPACK on 10.2.' || (u % 12) || '.' || (i % 250) || ' to ' || mac || ' via /var/run/eth0.log' END AS raw FROM ev)"""


def _sql_split(name: str, source: str) -> str:
    head = r"\d{4}-\d\d-\d\d[T\s]\d\d:\d\d:\d\d"
    return rf"""{name}_m AS (SELECT line_index, raw, regexp_extract(raw, '^([\s\S]*?)(\d{{4}}-\d\d-\d\d)[T\s](\d\d:\d\d:\d\d)([\s\S]*)$', ['before', 'day', 'clock', 'rest']) AS p, regexp_matches(raw, '{head}') AS hit FROM {source}),
{name} AS (SELECT line_index, raw, strftime(try_strptime(p.day || ' ' || p.clock, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts, ltrim(p.rest, ' ,|-:"') AS content,
  CASE WHEN NOT hit THEN 'no_match' WHEN length(p.before) > 200 THEN 'ts_too_far' WHEN try_strptime(p.day || ' ' || p.clock, '%Y-%m-%d %H:%M:%S') IS NULL THEN 'parse_failed' WHEN trim(ltrim(p.rest, ' ,|-:"')) = '' THEN 'empty_content' ELSE 'success' END AS status FROM {name}_m)"""


def _sql_skeleton(c: str) -> str:
    c = rf"regexp_replace({c}, '(www\.)?[a-zA-Z0-9.-]+[.](com|org|net|edu|gov|mil|int|co|io|me|tv|info|biz|name)', '', 'g')"
    c = rf"regexp_replace({c}, '[A-Za-z0-9-]*-[A-Za-z0-9-]*', '', 'g')"
    c = rf"regexp_replace({c}, '/[\w./\\-]+([|\s:,;!?]|$)', '\1', 'g')"
    c = rf"regexp_replace({c}, '[a-zA-Z]:\\[\w./\\-]+([|\s:,;!?]|$)', '\1', 'g')"
    c = rf"regexp_replace(regexp_replace({c}, '0x[[:xdigit:]]+', '', 'g'), '\b([[:xdigit:]][[:xdigit:]])+\b', '', 'g')"
    return rf"regexp_replace({c}, '[0-9=\s]', '', 'g')"


def _sql_clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace({c}, chr(9), ' '), '<\s*([^<>]*?)\s*>', '<\1>', 'g'), '\s\s+', ' ', 'g')) || '|'"


_PARSED = f"""{_LINES},
{_sql_split("split", "lines")},
clean AS (SELECT line_index, raw, ts, {_sql_clean("content")} AS content FROM split WHERE status = 'success'),
parsed AS (SELECT *, {_sql_skeleton("content")} AS skeleton FROM clean)"""


def _sql_table(most: int = 5) -> str:
    rows = ", ".join(f"({k}, '{s}', {f}, '^{p[2:-2]}$', '{n[1] if n else ''}')" for k, (s, f, n, p) in enumerate(_PARSERS[:most]))
    return f"parser AS (SELECT * FROM (VALUES {rows}) t(group_id, skeleton, flag, pattern, second))"


_RECORDS = f"""{_PARSED}, {_sql_table()},
hit AS (SELECT line_index, ts, flag, second, regexp_extract(content, pattern, 1) AS client_mac, regexp_extract(content, pattern, 2) AS ap FROM parsed JOIN parser USING (skeleton) WHERE flag <> 0),
records AS (SELECT line_index, ts, lower(client_mac) AS client_id, ap AS ap_id, CASE flag WHEN 1 THEN 'connect' ELSE 'disconnect' END AS event, flag, second FROM hit)"""

_EVENTS = "events_of AS (SELECT line_index, ts, CASE flag WHEN 1 THEN 'connect' ELSE 'disconnect' END AS event FROM parsed JOIN parser USING (skeleton) WHERE flag <> 0)"
_TRUTH = """truth AS (SELECT line_index, ts, CASE WHEN (event = 'connect') = (line_index % 13 = 0) THEN 'disconnect' ELSE 'connect' END AS event, ap_id, CASE WHEN line_index % 5 = 0 THEN replace(client_id, ':', '-') ELSE client_id END AS client_id FROM records WHERE line_index % 17 <> 0)"""
_ODD = """odd AS (SELECT line_index, CASE WHEN line_index % 37 = 0 THEN substr(raw, 21) WHEN line_index % 41 = 0 THEN repeat('x', 250) || raw WHEN line_index % 43 = 0 THEN '2024-13-45 00:00:00 ' || substr(raw, 21) WHEN line_index % 47 = 0 THEN substr(raw, 1, 19) ELSE raw END AS raw FROM lines)"""
_IDS = """made AS (SELECT line_index, client_id, ap_id, CASE line_index % 6 WHEN 0 THEN replace(client_id, ':', '-') WHEN 1 THEN replace(client_id, ':', '')
  WHEN 2 THEN substr(replace(client_id, ':', ''), 1, 4) || '.' || substr(replace(client_id, ':', ''), 5, 4) || '.' || substr(replace(client_id, ':', ''), 9, 4) WHEN 3 THEN '  ' || upper(ap_id) || ' ' WHEN 4 THEN 'NaN' ELSE client_id END AS value FROM records)"""
_PAIR = r"regexp_replace({}, '^(..)(..)(..)(..)(..)(..)$', '\1:\2:\3:\4:\5:\6')"


def _sql_id(c: str) -> str:
    v = f"lower(trim({c}))"
    bare = f"replace(replace(replace({v}, '-', ':'), '.', ''), ' ', '')"
    return f"CASE WHEN {v} IN ('', 'nan') THEN '' WHEN regexp_full_match({bare}, '[0-9a-f]{{12}}') THEN {_PAIR.format(bare)} ELSE {v} END"


def _sql_token(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def _sql_match(p: str, t: str) -> str:
    a, b = f"({_sql_id(p)})", f"({_sql_id(t)})"
    ca, cb = _sql_token(a), _sql_token(b)
    return f"({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a}) OR ({ca} <> '' AND {cb} <> '' AND (contains({ca}, {cb}) OR contains({cb}, {ca})))))"


def _sql_by_line(n_lines: int = 1 << 40, client: bool = True) -> str:
    return f"""t AS (SELECT * FROM truth WHERE line_index < {n_lines}), j AS (SELECT t.line_index, t.event = e.event AS same, t.event = r.event AS same_record, {_sql_match('r.ap_id', 't.ap_id')} AS ap, {_sql_match('r.client_id', 't.client_id')} AS cl FROM t LEFT JOIN events_of e USING (line_index) LEFT JOIN records r USING (line_index)),
c AS (SELECT CAST(count_if(same) AS BIGINT) AS tp, CAST(count(*) AS BIGINT) AS n_truth, (SELECT count(*) FROM events_of) AS n_pred, CAST(count_if(same_record AND ap AND {'cl' if client else 'true'}) AS BIGINT) AS field_tp, avg(CAST(ap AS INT)) AS aa, avg(CAST(cl AS INT)) AS ca, avg(CAST(coalesce(same, false) AS INT)) AS fa FROM j),
scores AS (SELECT 'line_index' AS matching, round(tp / n_pred, 6) AS event_precision, round(tp / n_truth, 6) AS event_recall, round(2.0 * (tp / n_pred) * (tp / n_truth) / ((tp / n_pred) + (tp / n_truth)), 6) AS event_f1, round({'(aa + ca + fa) / 3' if client else '(aa + fa) / 2'}, 6) AS field_extraction_accuracy,
tp AS event_tp, n_pred - tp AS event_fp, n_truth - tp AS event_fn, field_tp, n_truth AS gt_events, n_pred AS pred_events FROM c)"""


def _sql_by_record(rows: str = "records", client: bool = True, extracted: bool = False) -> str:
    """Matches inside a second and event one truth value at a time: the longest first, each takes the free prediction with most equal parts, the first of equals."""
    fit = lambda a, b: f"(contains(p[k].{a}, g[i].{a}) OR contains(g[i].{a}, p[k].{a}) OR (p[k].{b} <> '' AND g[i].{b} <> '' AND (contains(p[k].{b}, g[i].{b}) OR contains(g[i].{b}, p[k].{b}))))"
    side = lambda name, table: f"SELECT '{name}' AS side, ts, event, {_sql_id('ap_id')} AS ap, {_sql_id('client_id')} AS cl, line_index AS pos FROM {table}"
    item = f"{{'x': x, 'y': y, 'cx': {_sql_token('x')}, 'cy': {_sql_token('y')}}}"
    return f"""sides AS ({side('g', 'truth')} UNION ALL {side('p', rows)}),
items AS (SELECT 'ap' AS kind, side, ts, event, ap AS x, ap AS y, pos FROM sides WHERE ap <> '' UNION ALL SELECT 'client', side, ts, event, cl, cl, pos FROM sides WHERE cl <> '' UNION ALL SELECT 'pair', side, ts, event, ap, cl, pos FROM sides WHERE ap <> '' AND cl <> ''),
lists AS (SELECT kind, ts, event, list({item} ORDER BY length(x) + length(y) DESC, pos) FILTER (WHERE side = 'g') AS g, list({item} ORDER BY pos) FILTER (WHERE side = 'p') AS p FROM items GROUP BY kind, ts, event),
walk AS (SELECT kind, ts, event, g, p, 1 AS i, CAST([] AS BIGINT[]) AS used, 0 AS n FROM lists WHERE g IS NOT NULL AND p IS NOT NULL
  UNION ALL SELECT kind, ts, event, g, p, i + 1, CASE WHEN m IS NULL THEN used ELSE list_append(used, ((m % 1000000) + 1000000) % 1000000) END, n + CASE WHEN m IS NULL THEN 0 ELSE 1 END
  FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(p) + 1), lambda k: NOT list_contains(used, k) AND {fit('x', 'cx')} AND {fit('y', 'cy')}), lambda k: k - 1000000 * (CAST(p[k].x = g[i].x AS INT) + CAST(p[k].y = g[i].y AS INT)))) AS m FROM walk WHERE i <= len(g))),
ok AS (SELECT kind, sum(n) AS n FROM walk WHERE i = len(g) + 1 GROUP BY kind),
every AS (SELECT kind, sum(len(coalesce(g, []))) AS n, sum(least(len(coalesce(g, [])), len(coalesce(p, [])))) AS least_n FROM lists GROUP BY kind),
gk AS (SELECT ts, event, count(*) AS g FROM truth GROUP BY 1, 2), pk AS (SELECT ts, event, count(*) AS p FROM events_of GROUP BY 1, 2), k AS (SELECT coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM gk FULL JOIN pk USING (ts, event)),
c AS (SELECT CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(g) AS BIGINT) AS n_truth, CAST(sum(p) AS BIGINT) AS n_pred, (SELECT n FROM ok WHERE kind = 'ap') AS ap_ok, (SELECT n FROM ok WHERE kind = 'client') AS client_ok, (SELECT n FROM ok WHERE kind = 'pair') AS pair_ok,
  (SELECT {'least_n' if extracted else 'n'} FROM every WHERE kind = 'ap') AS ap_all, (SELECT {'least_n' if extracted else 'n'} FROM every WHERE kind = 'client') AS client_all FROM k),
scores AS (SELECT 'record' AS matching, round(tp / n_pred, 6) AS event_precision, round(tp / n_truth, 6) AS event_recall, round(2.0 * (tp / n_pred) * (tp / n_truth) / ((tp / n_pred) + (tp / n_truth)), 6) AS event_f1, round({'(ap_ok / ap_all + client_ok / client_all + tp / n_truth) / 3' if client else '(ap_ok / ap_all + tp / n_truth) / 2'}, 6) AS field_extraction_accuracy,
tp AS event_tp, n_pred - tp AS event_fp, n_truth - tp AS event_fn, CAST({'pair_ok' if client else 'ap_ok'} AS BIGINT) AS field_tp, n_truth AS gt_events, n_pred AS pred_events FROM c)"""


def _sql_text(value: str | None) -> str:
    """A text as SQL, its signs that are not printable ASCII by number."""
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    return "''" if not value else " || ".join(f"chr({ord(c)})" if not " " <= c <= "~" else "'" + c.replace("'", "''") + "'" for c in value)


def _sql_rows(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(str(v) if isinstance(v, int | float) else _sql_text(v) for v in r) + ')' for r in rows)}) t({columns})"


_MARKED = """marked AS (SELECT line_index, CASE WHEN line_index % 11 = 0 THEN raw || chr(11) || 'more' || chr(8232) || 'and more' WHEN line_index % 13 = 0 THEN raw WHEN line_index % 17 = 0 THEN '' WHEN line_index % 19 = 0 THEN raw || ' ' || chr(65533) ELSE raw END AS raw FROM lines)"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["records_by_ap"] = f"WITH {_RECORDS} SELECT ap_id, event, count(*) AS n FROM records GROUP BY 1, 2"
    o["lines_clean"] = f"WITH {_LINES} SELECT line_index, raw AS line FROM lines"
    o["sample_lines"] = f"WITH {_LINES} SELECT line_index, raw FROM lines ORDER BY line_index LIMIT 500"
    o["strided_lines"] = f"WITH {_LINES}, n AS (SELECT *, row_number() OVER (ORDER BY line_index) - 1 AS k, greatest(count(*) OVER () // 100, 1) AS step FROM lines) SELECT min(line_index) AS line_index, raw FROM n WHERE k % step = 0 GROUP BY raw ORDER BY 1 LIMIT 100"
    o["chunk_labels"] = f"WITH {_LINES} SELECT line_index // 500 AS chunk, max(line_index % 500 + 1) AS fill FROM lines GROUP BY 1"
    o["header_split"] = f"WITH {_LINES}, {_sql_split('split', 'lines')} SELECT line_index, ts, content FROM split"
    o["header_report"] = f"WITH {_LINES}, {_ODD}, {_sql_split('split', 'odd')}, k AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY line_index) AS place FROM split) SELECT status, count(*) AS n, string_agg(raw, chr(10) ORDER BY line_index) FILTER (WHERE place <= 5) AS examples FROM k GROUP BY 1"
    o["preprocess"] = f"WITH {_PARSED} SELECT line_index, content FROM parsed"
    o["skeleton"] = f"WITH {_PARSED} SELECT line_index, skeleton FROM parsed"
    grouped = "g AS (SELECT skeleton, count(*) AS n, min(line_index) AS first_idx, arg_min(content, line_index) AS representative FROM parsed GROUP BY 1)"
    o["micro_groups"] = f"WITH {_PARSED}, {grouped} SELECT *, row_number() OVER (ORDER BY first_idx, skeleton) - 1 AS group_id FROM g"
    o["micro_group_sample"] = f"WITH {_PARSED} SELECT skeleton, line_index FROM parsed QUALIFY row_number() OVER (PARTITION BY skeleton ORDER BY line_index) <= 200"
    o["eligible_groups"] = f"WITH {_PARSED} SELECT skeleton, count(*) AS n FROM parsed GROUP BY 1 HAVING count(*) >= 2000"
    o["groups_by_size"] = f"WITH {_PARSED}, {grouped} SELECT skeleton, row_number() OVER (ORDER BY n DESC, first_idx) AS place FROM g"
    half = lambda name, k: f"{name} AS (SELECT skeleton, count(*) AS n, min(line_index) AS first_idx, arg_min(content, line_index) AS representative FROM parsed WHERE line_index % 2 = {k} GROUP BY 1)"
    o["merged_groups"] = f"""WITH {_PARSED}, {half("a", 0)}, {half("b", 1)}, m AS (SELECT skeleton, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, coalesce(a.first_idx, b.first_idx) AS first_idx, coalesce(a.representative, b.representative) AS representative, a.n IS NULL AS fresh FROM a FULL JOIN b USING (skeleton))
SELECT skeleton, n, first_idx, representative, row_number() OVER (ORDER BY fresh, first_idx, skeleton) - 1 AS group_id FROM m"""
    o["distinct_lines"] = f"WITH {_PARSED} SELECT content, min(line_index) AS line_index FROM parsed GROUP BY 1"
    o["json_keys"] = rf"""WITH {_PARSED}, f AS (SELECT unnest(regexp_extract_all(content, '\{{[^}}]*\}}')) AS f FROM parsed), k AS (SELECT unnest(regexp_extract_all(f, '"([^"]+)"\s*:', 1)) AS key FROM f) SELECT DISTINCT key FROM k"""
    o["json_standard"] = rf"""WITH {_PARSED} SELECT line_index, regexp_replace(content, '\{{"k": (-?\d+)\}}', '{{"a":"","k":\1}}') AS content FROM parsed WHERE contains(content, '{{')"""
    o["fields"] = f"WITH {_RECORDS} SELECT line_index, client_mac, CASE WHEN second = 'ap_name' THEN ap END AS ap_name, CASE WHEN second = 'ap_ip' THEN ap END AS ap_ip FROM hit"
    o["wifi_records"] = f"WITH {_RECORDS} SELECT line_index, ts, ap_id, client_id, event, flag FROM records"
    o["record_payload"] = f"WITH {_RECORDS} SELECT ap_id, client_id, replace(ts, ' ', 'T') AS timestamp, event, line_index, flag AS connect_flag FROM records"
    o["line_events"] = f"WITH {_PARSED}, {_sql_table()}, {_EVENTS} SELECT * FROM events_of"
    o["cache_stats"] = f"WITH {_PARSED}, {_sql_table(4)}, j AS (SELECT group_id FROM parsed LEFT JOIN parser USING (skeleton)) SELECT count(group_id) AS hits, count(*) - count(group_id) AS misses, (SELECT count(*) FROM parser) AS patterns, count(*) AS total, round(100.0 * count(group_id) / count(*), 6) AS hit_rate FROM j"
    bare = "lower(replace(replace(replace(trim(value), '-', ':'), '.', ''), ' ', ''))"
    mac = f"CASE WHEN length({bare}) = 12 AND NOT contains({bare}, ':') THEN {_PAIR.format(bare)} ELSE {bare} END"
    o["mac_norm"] = f"WITH {_RECORDS}, {_IDS} SELECT line_index, {mac} AS mac, regexp_full_match({bare}, '([0-9a-f]{{2}}:){{5}}[0-9a-f]{{2}}|[0-9a-f]{{12}}') AS is_mac FROM made"
    o["id_norm"] = f"WITH {_RECORDS}, {_IDS} SELECT line_index, {_sql_id('value')} AS id, {_sql_token('value')} AS token FROM made"
    o["event_norm"] = f"WITH {_LINES} SELECT line_index, CASE WHEN line_index % 7 < 3 THEN 'connect' WHEN line_index % 7 < 5 THEN 'disconnect' ELSE '' END AS event FROM lines"
    o["time_norm"] = f"WITH {_RECORDS} SELECT line_index, CASE WHEN line_index % 3 < 2 THEN ts ELSE '' END AS ts FROM records"
    o["partial_match"] = f"WITH {_RECORDS}, {_IDS} SELECT line_index, {_sql_match('value', 'client_id')} AS client, {_sql_match('value', 'ap_id')} AS ap FROM made"
    every = ", ".join([*[f"({k}, '^{p[2:-2]}$')" for k, (*_, p) in enumerate(_PARSERS)], r"(9, '^stm\[.*?\]: .*\|$')"])
    o["coverage_matrix"] = f"""WITH {_PARSED}, p AS (SELECT * FROM (VALUES {every}) t(parser_id, pattern)), s AS (SELECT skeleton, content FROM parsed QUALIFY row_number() OVER (PARTITION BY skeleton ORDER BY line_index) <= 200)
SELECT parser_id, skeleton FROM s, p GROUP BY 1, 2 HAVING bool_and(regexp_matches(content, pattern))"""
    o["consolidated_groups"] = f"""WITH {_PARSED}, {grouped}, w AS (SELECT skeleton FROM g WHERE skeleton LIKE 'stm%' ORDER BY n DESC, first_idx LIMIT 1)
SELECT skeleton, CASE WHEN skeleton LIKE 'stm%' THEN (SELECT skeleton FROM w) ELSE skeleton END AS canonical, skeleton LIKE 'stm%' AS parsed FROM g"""
    keyed = f"{_RECORDS}, {_EVENTS}, {_TRUTH}"
    o["eval_line_index"] = f"WITH {keyed}, {_sql_by_line()} SELECT * FROM scores"
    o["eval_no_client"] = f"WITH {keyed}, {_sql_by_line(700, False)} SELECT * FROM scores"
    o["eval_record"] = f"WITH RECURSIVE {keyed}, {_sql_by_record()} SELECT * FROM scores"
    o["eval_record_extracted"] = f"WITH RECURSIVE {keyed}, fewer AS (SELECT * FROM records WHERE line_index % 7 <> 0), {_sql_by_record('fewer', False, True)} SELECT * FROM scores"
    o["eval_repeated"] = f"""WITH {keyed}, t AS (SELECT ts, event FROM truth UNION ALL SELECT ts, event FROM truth WHERE line_index = 1), g AS (SELECT ts, event, count(*) AS g FROM t GROUP BY 1, 2), p AS (SELECT ts, event, count(*) AS p FROM events_of GROUP BY 1, 2), k AS (SELECT coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p USING (ts, event))
SELECT 'record' AS matching, CAST(sum(least(g, p)) AS BIGINT) AS event_tp, CAST(sum(greatest(p - g, 0)) AS BIGINT) AS event_fp, CAST(sum(greatest(g - p, 0)) AS BIGINT) AS event_fn, CAST(sum(g) AS BIGINT) AS gt_events, CAST(sum(p) AS BIGINT) AS pred_events FROM k"""
    o["eval_record_events"] = f"""WITH {keyed}, g AS (SELECT ts, event, count(*) AS g FROM truth GROUP BY 1, 2), p AS (SELECT ts, event, count(*) AS p FROM events_of GROUP BY 1, 2), k AS (SELECT coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p USING (ts, event))
SELECT CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(greatest(p - g, 0)) AS BIGINT) AS fp, CAST(sum(greatest(g - p, 0)) AS BIGINT) AS fn FROM k"""
    o["events_common"] = f"WITH {keyed} SELECT line_index, event FROM events_of INTERSECT SELECT line_index, event FROM truth"
    o["events_only_predicted"] = f"WITH {keyed} SELECT line_index, event FROM events_of EXCEPT ALL SELECT line_index, event FROM truth"
    o["run_stats"] = f"""WITH {_LINES}, {_ODD}, {_sql_split('split', 'odd')}, kept AS (SELECT {_sql_skeleton(_sql_clean('content'))} AS skeleton FROM split WHERE status = 'success'), k AS (SELECT count(*) AS n FROM kept GROUP BY skeleton)
SELECT (SELECT count(*) FROM split) AS lines, (SELECT count(*) FROM kept) AS lines_kept, count(*) AS n_groups, CAST(count_if(n < 100) AS BIGINT) AS too_small FROM k"""
    o["ap_transitions"] = f"WITH {_RECORDS}, m AS (SELECT lag(ap_id) OVER (PARTITION BY client_id ORDER BY ts, line_index) AS from_ap, ap_id AS to_ap FROM records WHERE event = 'connect') SELECT from_ap, to_ap, count(*) AS n FROM m WHERE from_ap <> to_ap GROUP BY 1, 2"
    o["ap_hotspots"] = f"WITH {_RECORDS} SELECT ap_id, count(*) AS connects, count(DISTINCT client_id) AS clients FROM records WHERE event = 'connect' GROUP BY 1"
    doc = f"d AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), k AS (SELECT doc_id, n, {_sql_skeleton('line')} AS skeleton FROM d)"
    o["doc_skeletons"] = f"WITH {doc} SELECT doc_id, n, skeleton FROM k"
    o["doc_dupe_groups"] = f"WITH {doc} SELECT skeleton, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k GROUP BY 1 HAVING count(*) > 1"
    for name in ("stream_records", "engine_records", "engine_file_records", "engine_log_records", "baseline_records"):
        o[name] = o["wifi_records"]
    o["stream_counts"] = f"WITH {_RECORDS} SELECT strftime(time_bucket(INTERVAL '5 minutes', CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS start, ap_id, event, count(*) AS n FROM records GROUP BY 1, 2, 3"
    o["file_lines"] = f"WITH {_LINES}, {_MARKED} SELECT line_index, raw FROM marked"
    o["whole_lines"] = f"WITH {_LINES}, {_MARKED}, u AS (SELECT line_index, generate_subscripts(s, 1) AS n, unnest(s) AS raw FROM (SELECT line_index, string_split(replace(raw, chr(8232), chr(11)), chr(11)) AS s FROM marked)) SELECT row_number() OVER (ORDER BY line_index, n) - 1 AS line_index, raw FROM u"
    o["line_count"] = "SELECT count(*) AS n FROM events"
    o["truth_rows"] = f"WITH {keyed} SELECT CAST(line_index AS VARCHAR) AS OriginalLineIdx, ts AS DateTime, event AS Action, ap_id AS ApId, '' AS BSSID, client_id AS ClientId FROM truth"
    o["batch_sizes"] = f"WITH {_RECORDS}, n AS (SELECT count(*) AS n FROM records), b AS (SELECT unnest(range(CAST(ceil(n / 700) AS BIGINT))) AS batch, n FROM n) SELECT batch, least(700, n - 700 * batch) AS n FROM b"
    counted = "(SELECT count(*) FROM lines) AS lines, (SELECT count(DISTINCT skeleton) FROM parsed) AS groups, (SELECT count(*) FROM records) AS records"
    by_record = _sql_by_record(client=False)
    o["summary_file"] = f"""WITH RECURSIVE {keyed}, lined AS (WITH {_sql_by_line()} SELECT * FROM scores), recorded AS (WITH RECURSIVE {by_record} SELECT * FROM scores)
SELECT 'by_line' AS dataset, *, {counted} FROM lined UNION ALL SELECT 'by_record', *, {counted} FROM recorded"""
    o["records_file"] = f"WITH {_RECORDS} SELECT ap_id, client_id, replace(records.ts, ' ', 'T') AS timestamp, event, raw AS raw_log, line_index, flag AS connect_flag, 'header' AS source FROM records JOIN lines USING (line_index)"
    o["json_files"] = f"WITH {keyed}, {_sql_by_line()} SELECT (SELECT count(*) FROM lines) AS lines, (SELECT count(*) FROM parsed) AS lines_kept, event_tp, CAST(2 AS BIGINT) AS datasets FROM scores"
    o["catalogue_times"] = f"WITH {_LINES} SELECT line_index, CASE WHEN line_index % 7 = 5 THEN '1970' || substr(raw, 5, 15) ELSE substr(raw, 1, 19) END AS ts, '] up' AS content FROM lines"
    o["tricky_lines"] = _sql_rows([(k, status, second, content, skeleton) for k, (status, second, content, skeleton) in enumerate(TRICKY_WANT)], "line_index, status, second, content, skeleton")
    said = [("reply", k, want, str(flag)) for k, (_, want, flag) in enumerate(REPLIES)] + [("regex reply", 0, r"a\d", "1")] + [("template", k, want, names) for k, (_, want, names) in enumerate(TEMPLATES)]
    said += [("pattern", k, want, names) for k, (_, want, names) in enumerate(PYTHON_REGEXES)] + [("anchored", k, want, None) for k, want in enumerate([r"\Aa\Z", r"^a\Z", r"\Aa$"])]
    said += [("validated", 0, "True", ""), ("validated", 1, "False", "syntax_error"), ("validated", 2, "False", "input_error"), ("validated", 3, "False", "match_fail")]
    said += [("located", 0, r"pattern fails at: (\d+) | line there: x", None), ("captured", 0, '{"ap": "a1", "no": null}', None), ("repair sample", 0, "c,a,b,d,e", None), ("similar", 0, "up one,up two,down far off", None)]
    said += [("asked", 0, "('x', -1)", None), ("asked", 1, "y", None), ("asked", 2, "3", None), ("asked", 3, "fallback0,fallback1,primary", None), ("tokens", 0, "7", None)]
    o["induction_texts"] = _sql_rows(said, "kind, place, found, more")
    o["times"] = f"WITH {_LINES}, t AS (SELECT line_index, substr(raw, 1, 19) AS t FROM lines) SELECT line_index, substr(t, 1, 17) || '00' AS merged, substr(t, 1, 17) || '00' AS joined, t AS whole, t AS read, strftime(CAST(t AS TIMESTAMP) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS utc, CAST(10 AS BIGINT) AS tokens FROM t"
    o["header_texts"] = _sql_rows([
        ("inferred", r"(?P<date>\d{4}-\d\d-\d\d)[T\s](?P<time>\d\d:\d\d:\d\d)"), ("catalogue", r"(?P<date>\d{4}-\d\d-\d\d)[T\s](?P<time>\d\d:\d\d:\d\d)"), ("asked", "3"), ("told", "True"), ("missing", "3"), ("json", '{"a": {"b": 1}}'), ("none", "None"),
        ("primary_model", "m"), ("base_url", "u"), ("fallback_models", "('b', 'c')"), ("request_timeout_seconds", "1.0"), ("max_retries", "2"), ("disable_fallback", "True"), ("batch_size", "8"), ("legacy", "2024-05-06 00:00:00"), ("names", "a,c"),
    ], "name, value")
    o["random_sample"] = f"WITH {_PARSED}, s AS (SELECT DISTINCT skeleton, content FROM (SELECT skeleton, content FROM parsed QUALIFY row_number() OVER (PARTITION BY skeleton ORDER BY line_index) <= 200)) SELECT skeleton, row_number() OVER w - 1 AS place, content AS line FROM s WINDOW w AS (PARTITION BY skeleton ORDER BY sha1('0' || chr(0) || content)) QUALIFY row_number() OVER w <= 8"
    o["engine_names"] = "SELECT * FROM (VALUES ('log_extractor', false, true), ('wifi_log_parser', true, true)) t(name, standard, told)"
    o["progress_events"] = "SELECT * FROM (VALUES (0, 0.03, 0, 30), (1, 0.15, 2, 50), (2, 0.27, 5, 20), (3, 0.3, 5, 50)) t(place, fraction, chunk, fill)"
    return o
