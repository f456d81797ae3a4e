import json
from datetime import datetime

import pytest

from roamspark.operators import header
from roamspark.sources import lines as sources

RULE = header.HeaderRule(r"(?P<date>\d{4}-\d\d-\d\d)\s(?P<time>\d\d:\d\d:\d\d)", "%Y-%m-%d", "%H:%M:%S")
LINES = ["2024-01-02 03:04:05 up", "[2024-01-01 00:00:01] x", "nothing", "x" * 250 + " 2024-01-02 03:04:05 y", "2024-13-45 00:00:00 y", "2024-01-02 03:04:05", "\t2024-01-02 03:04:05\t- |a", "", None]


@pytest.mark.parametrize("rule", [RULE, header.HeaderRule(r"(?P<date>\d{4}-\d\d-\d\d)\s(?P<time>\d\d:\d\d:\d\d)(?:(?=])|)", "%Y-%m-%d", "%H:%M:%S")])
def test_native_and_python_agree(spark, rule):
    df = spark.createDataFrame(list(enumerate(LINES)), "line_index long, raw string")
    want = [header.split_text(x, rule) for x in LINES]
    for split in (header.split_header, header._python):
        got = split(df, rule).orderBy("line_index").collect()
        assert [(r.ts, r.content, r.status) for r in got] == want


def test_content_after_bracket():
    assert header.split_text(LINES[1], RULE)[1] == "] x"


def test_no_year_and_zone(spark):
    rule = header.HeaderRule(r"(?P<date>[A-Z][a-z]{2}\s+\d{1,2})\s+(?P<time>\d\d:\d\d:\d\d)", "%b %d", "%H:%M:%S", False)
    df = sources.lines_of(spark, ["Jan  1 00:00:02 host a", "Feb 29 00:00:00 b"])
    rows = header.split_header(df, rule).orderBy("line_index").collect()
    assert rows[0].ts == datetime(1970, 1, 1, 0, 0, 2) and rows[1].status == "parse_failed"
    zone = header.HeaderRule(r"(?P<date>\d{4}-\d\d-\d\d)T(?P<time>\d\d:\d\d:\d\d(?:Z|[+-]\d{4}))", "%Y-%m-%d", "%H:%M:%S%z")
    got = header.split_header(sources.lines_of(spark, ["2024-01-01T10:00:00Z a", "2024-01-01T10:00:00+0200 b"]), zone).orderBy("line_index").collect()
    assert [r.ts.hour for r in got] == [10, 8]


def test_infer(spark):
    df = sources.lines_of(spark, ["2024-01-02 03:04:05 up"] * 9 + ["junk"])
    assert header.infer(df).date_format == "%Y-%m-%d"
    with pytest.raises(ValueError):
        header.infer(sources.lines_of(spark, ["junk"] * 5))
    calls = []

    def propose(lines, rule, counts):
        calls.append(counts)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return header.HeaderRule(r"(?P<date>\d{9})(?P<time>\d)", "%Y", "%H") if len(calls) == 2 else RULE

    assert header.infer(df, propose) is RULE and calls == [None, None, {"no_match": (10, ["2024-01-02 03:04:05 up"] * 5)}]


def test_rule_replies():
    with pytest.raises(ValueError):
        header.HeaderRule.from_reply({"regex": "(?P<date>x)", "date_format": "%Y", "time_format": "%H"})
    assert header.json_in('so: {"a": 1} ok') == {"a": 1} and header.json_in("none") is None
    assert header.DateRule(r"(?P<ts>\d{4})", "%Y").usable(["x", "2024"])


def test_sources(spark, tmp_path):
    at = tmp_path / "a.log"
    at.write_bytes(b"one\r\n\n\xfftwo\rx\r\r\nend")
    assert [(r.line_index, r.raw) for r in sources.read_lines(spark, str(at)).orderBy("line_index").collect()] == [(0, "one"), (1, ""), (2, "two\rx"), (3, "end")]
    assert [r.raw for r in sources.read_whole(spark, str(at)).orderBy("line_index").collect()] == ["one", "", "two", "x", "", "end"]
    gt = tmp_path / "gt.csv"
    gt.write_text("OriginalLineIdx,Action,ApId\n1,connect,a\n2,-1\n3,1,b,extra\n")
    assert [tuple(r) for r in sources.read_ground_truth(spark, str(gt)).collect()] == [("1", "connect", "a"), ("2", "-1", "")]
    cfg = tmp_path / "c.json"
    cfg.write_text(json.dumps({"llm": {"primary_model": "m", "request_timeout_seconds": 0}, "datasets": [{"name": "a", "log_path": str(at)}, {"name": "b", "log_path": "x"}]}))
    e = sources.Experiment.load(str(cfg), ["a"])
    assert [d.name for d in e.datasets] == ["a"] and e.settings.request_timeout_seconds == 1.0
    assert sources.Settings.load({"llm": {"primary_model": "m"}}, {"ROAMSPARK_MODEL": "n"}).primary_model == "n"
    with pytest.raises(ValueError):
        sources.Experiment.load(str(cfg), ["c"])


def test_lines_in_pieces(spark, monkeypatch):
    """Lines that are made one after another are numbered in their order, and the driver holds few of them at a time."""
    texts = [None if k % 7 == 0 else "" if k % 5 == 0 else f"line {k}" for k in range(1000)]
    sizes, made = [], sources.local_table
    monkeypatch.setattr(sources, "local_table", lambda s, rows, schema: sizes.append(len(rows)) or made(s, rows, schema))
    for most, pieces in ((1 << 20, 1), (64 * 300, 4)):
        sizes.clear()
        got = sources.lines_of(spark, iter(texts), most)
        assert [tuple(r) for r in got.orderBy("line_index").collect()] == list(enumerate(texts)) and len(sizes) == pieces
    assert max(sizes) <= 300 and sources.lines_of(spark, iter([])).count() == 0
