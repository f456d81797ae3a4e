import json
import random

import numpy as np
import pytest

from roamspark.operators import evaluate, header, induce, sampling
from roamspark.operators.consolidate import induce_all
from roamspark.operators.templates import Parser, anchored, compile_template, flag_of, regex_reply, template_reply, translate
from roamspark.plans import engines
from roamspark.sources import lines as sources
from roamspark.sources import sinks

LOGS = [f"2024-01-01 00:00:{i:02d} stm[1]: Assoc success: STA 02:00:00:00:00:{i:02x} AP AP-B{i % 3}-F1 ssid=x" for i in range(20)] + [f"2024-01-01 00:01:{i:02d} dhcpd: DHCPACK on 10.0.0.{i}" for i in range(5)] + ["", "no header"]


def test_templates():
    pattern, names = compile_template("a.{{client_mac}} {{ssid}} {{ap_name_1}}|")
    assert pattern == r"(?d)\Aa\.(.*?) .*? (.*?)\|\z" and names == ("client_mac", "ap_name_1")
    with pytest.raises(ValueError):
        compile_template("  ")
    assert anchored("a$") == r"\Aa$" and anchored(r"\Aa") == r"\Aa\Z"
    assert translate(r"(?P<a>x)(y)\Z") == (r"(?Ud)(x)(?:y)\z", ("a",))
    assert translate("(") is None


def test_replies():
    assert template_reply('text ```json\n{"template": "a", "connect_flag": -1}\n```') == ("a", -1)
    assert template_reply('{"template": " ", "connect_flag": "x"}') == (None, 0)
    assert regex_reply('{"regex": "a\\d", "connect_flag": 1') == ("a\\d", 1)
    assert flag_of("+1") == 1 and flag_of(True) == 0 and flag_of(None) == 0


def test_validate():
    assert induce.validate("a", ["ab"])[0]
    ok, failed, info, kind = induce.validate(r"a b c", ["a b c", "a x c"])
    assert (ok, failed, kind) == (False, "a x c", "match_fail") and "line there: x c" in info
    assert induce.validate("(", ["a"])[3] == "syntax_error" and induce.validate("", [])[3] == "input_error"


def test_diverse_sample():
    lines = [f"alpha beta {w}" for w in ("one", "two", "three")] + ["gamma delta"]
    assert sampling.sample(lines, 2) == [lines[0], lines[3]]
    assert sampling.sample(lines * 2, 4) == lines
    with pytest.raises(ValueError):
        sampling.tfidf(["a", "!"])
    parts = sampling.kmeans_batches(np.eye(7), 3)
    assert sorted(sum(parts, [])) == list(range(7)) and max(map(len, parts)) <= 3
    assert sampling.repair_sample(list("abcdefg"), "f") == ["f", "a", "b", "c", "d"]


def test_induction_state():
    groups = [{"group_id": k, "skeleton": s, "n": n, "first_idx": k, "representative": s, "sample": [s]} for k, (s, n) in enumerate([("a1", 5), ("a2", 9), ("b", 1), ("c", 3)])]

    def one(g):
        if g["skeleton"] == "c":
            raise RuntimeError("no words")
        return Parser("a", (), 0) if g["skeleton"] == "a2" else Parser(None, (), 1)

    run = induce_all(groups, 2, one, lambda p, g: g["skeleton"][0] == "a")
    assert run.canon == {"a1": 1, "a2": 1, "b": 2, "c": 3} and run.consolidated == {0} and run.details[3]["flag"] == 0 and 3 not in run.parsers
    assert run.counts() == {"processed": 2, "too_small": 1, "consolidated": 1, "consolidated_too_small": 0, "consolidated_eligible": 1, "skipped": 2, "unmatched": 1}


def brute(truth, pred):
    used, n = [False] * len(pred), 0
    for t in sorted(truth, key=lambda x: sum(map(len, x)), reverse=True):
        best, score = None, -1
        for j, p in enumerate(pred):
            if not used[j] and all(evaluate._fits(a, b) for a, b in zip(p, t)):
                k = sum(a == b for a, b in zip(p, t))
                if k > score:
                    best, score = j, k
        if best is not None:
            used[best] = True
            n += 1
    return n


def test_greedy_matching():
    rng = random.Random(1)
    for _ in range(300):
        make = lambda: [(rng.choice(["a", "ab", "abc", "b"]), rng.choice(["x", "xy", "z"])) for _ in range(rng.randint(0, 6))]
        t, p = make(), make()
        assert evaluate.matched(t, p) == brute(t, p)


def test_engine(spark, tmp_path):
    e = engines.get_engine()(spark)
    got = e.process_logs(LOGS)
    assert got.stats["lines"] == 27 and got.stats["lines_kept"] == 25 and got.stats["records"] == 20 and got.stats["groups"] == 2
    r = got.records.orderBy("line_index").first()
    assert (r.client_id, r.ap_id, r.event) == ("02:00:00:00:00:00", "AP-B0-F1", "connect")
    parts = []
    assert e.process_logs_stream(LOGS, parts.append, 8).streamed == 20 and [len(p) for p in parts] == [8, 8, 4]
    assert e.process_logs([]).stats["lines"] == 0
    at = tmp_path / "w.log"
    at.write_text("\n".join(LOGS) + "\n")
    base = engines.get_engine("log_extractor")(spark, inducer=induce.Recorded({}, key=str))
    base.inducer.parser = lambda lines, examples: (r"stm.*STA (?P<client_mac>\S+) AP (?P<ap_name>\S+)", 1) if "stm" in lines[0] else (None, 0)
    assert base.process_file(str(at)).stats["records"] == 20
    with pytest.raises(ValueError):
        engines.get_engine("other")
    assert engines.list_supported_engines() == ["log_extractor", "wifi_log_parser"]


class Server:
    """A chat server that gives its answers in turn: a status, or a text."""

    def __init__(self, *answers):
        import http.server
        import threading

        self.seen, left = [], list(answers)
        outer = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                outer.seen.append((self.path, self.headers["Authorization"], body))
                answer = left.pop(0)
                text = "" if isinstance(answer, int) else json.dumps({"choices": [{"message": {"content": answer}}], "usage": {"total_tokens": 17}})
                self.send_response(answer if isinstance(answer, int) else 200)
                self.send_header("Content-Length", str(len(text)))
                self.end_headers()
                self.wfile.write(text.encode())

            def log_message(self, *args):
                pass

        self.http = http.server.HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/v1"


def test_chat_and_hooks():
    told = []
    chat = induce.Chat(lambda m: json.dumps({"template": "{{client_mac}}|", "connect_flag": 1}), reserve=lambda m: "r", commit=lambda held, n: told.append((held, n > 0)), release=lambda held: told.append("released"))
    assert chat.parser(["x|"], []) == ("{{client_mac}}|", 1) and told == [("r", True)] and chat.usage.calls == 1
    chat.ask = lambda m: 1 / 0
    with pytest.raises(ZeroDivisionError):
        chat.parser(["x|"], [])
    assert told[1:] == ["released"] and chat.usage.calls == 1


def test_chat_client(spark):
    from roamspark.sources import chat as remote

    rule = {"regex": r"(?P<date>\d{4}-\d\d-\d\d) (?P<time>\d\d:\d\d:\d\d)", "date_format": "%Y-%m-%d", "time_format": "%H:%M:%S", "has_year": True}
    server = Server(503, json.dumps({**rule, "regex": r"(?P<date>\d{9})(?P<time>\d)"}), "no json", "so: " + json.dumps(rule), json.dumps({"template": "stm {{client_mac}}|", "connect_flag": 1}), 400)
    settings = sources.Settings(primary_model="m", fallback_models=("f",), base_url=server.url, max_retries=1)
    paused = []
    first, others = remote.clients(settings, "key")
    assert [c.model for c in others] == ["f"] and not remote.clients(sources.Settings(primary_model="m", fallback_models=("f",), base_url=server.url, disable_fallback=True), "key")[1]
    first.pause = paused.append
    chat = induce.Chat(first)
    lines = sources.lines_of(spark, [f"2024-01-02 03:04:0{k} up {k}" for k in range(9)] + ["junk"])
    assert header.infer(lines, chat.header).regex == rule["regex"] and paused == [0.5] and chat.usage.calls == 3 and chat.usage.tokens == 51 and chat.usage.by_model == {"m": 3}
    path, key, body = server.seen[-1]
    assert path == "/v1/chat/completions" and key == "Bearer key" and body["model"] == "m" and "no_match: 10 of 10" in body["messages"][1]["content"]
    assert chat.parser(["stm x|"], []) == ("stm {{client_mac}}|", 1)
    with pytest.raises(OSError):
        chat.parser(["x|"], [])
    with pytest.raises(ValueError):
        remote.Client(server.url, "", "m")
    dated = header.DateRule.build(["2024 a", "b"], lambda m: json.dumps({"regex": r"(?P<ts>\d{4})", "format": "%Y"}))
    assert dated.parse("in 2024").year == 2024
    with pytest.raises(ValueError):
        header.DateRule.build(["a"], lambda m: "{}")


def test_rounds_of_induction(spark, monkeypatch):
    """A few groups at a time give what all at once give."""
    logs = [f"2024-01-01 00:00:{k % 60:02d} {kind * n} {'x' * (n % 3)} AP a{k} STA 02:00:00:00:00:{k % 100:02d}" for n, kind in enumerate(["assoc ", "left ", "probe ", "join "] * 3, 1) for k in range(n)]
    want = None
    for at_once in (500, 2):
        monkeypatch.setattr(engines, "AT_ONCE", at_once)
        e = engines.get_engine()(spark, settings=sources.Settings(min_cluster_size=2))
        got = e.process_logs(logs)
        now = (sorted(map(str, got.records.collect())), sorted(e.run.canon.items()), e.run.counts())
        assert want is None or now == want
        want = now


def test_progress_of_a_job(spark):
    seen = []
    with sinks.Progress(seen.append, chunk=10).watching(spark, "scan", 1000, 0.2):
        spark.sparkContext.parallelize(range(16), 16).foreach(lambda x: __import__("time").sleep(0.4))
    assert seen and all(0 <= x["file_fraction"] <= 0.3 for x in seen)


def test_cli(spark, tmp_path):
    from roamspark.plans import cli

    (tmp_path / "w.log").write_text("\n".join(LOGS) + "\n")
    rows = ["OriginalLineIdx,DateTime,Action,ApId,BSSID,ClientId"] + [f"{i},2024-01-01 00:00:{i:02d},connect,AP-B{i % 3}-F1,,02-00-00-00-00-{i:02x}" for i in range(20)]
    (tmp_path / "gt.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "c.json").write_text(json.dumps({"datasets": [{"name": "d", "log_path": str(tmp_path / "w.log"), "gt_path": str(tmp_path / "gt.csv")}, {"name": "r", "log_path": str(tmp_path / "w.log"), "gt_path": str(tmp_path / "gt.csv"), "matching": "record"}]}))
    out = cli.run(spark, str(tmp_path / "c.json"), str(tmp_path / "out"), run_id="1")
    assert [r["event_f1"] for r in out] == [1.0, 1.0] and [r["matching"] for r in out] == ["line_index", "record"] and out[0]["field_extraction_accuracy"] == 1.0
    assert (tmp_path / "out/1/d/records.jsonl").exists() and (tmp_path / "out/1/summary_main.json").exists()


def test_stream_callback(spark, tmp_path):
    from roamspark.plans.queries import RULE, table
    from roamspark.streaming import stream

    spark.createDataFrame([(0, "2024-01-01 00:00:00 stm[3456]: Auth request: STA 02:00:00:00:00:01 AP 10.1.2.3")], "line_index long, raw string").write.parquet(str(tmp_path / "in"))
    rows = stream.stream_records(spark.readStream.schema("line_index long, raw string").parquet(str(tmp_path / "in")), RULE, table(spark))
    got = []
    stream.to_callback(rows, got.append, str(tmp_path / "state")).awaitTermination()
    assert [r["ap_id"] for part in got for r in part] == ["10.1.2.3"]


def test_progress():
    seen = []
    clock = iter([0.0, 0.0, 0.5, 5.0, 5.0, 9.0, 9.0])
    p = sinks.Progress(seen.append, lambda: next(clock))
    p("scan", 0.5)
    p("scan", 0.6)
    p("induce", 0.5)
    assert [round(x["file_fraction"], 2) for x in seen] == [0.15, 0.5]
    assert sinks.chunk_label(50_001, 50_000) == (1, 1) and sinks.batch_size("x") == 2000 and sinks.batch_size(0) == 1
