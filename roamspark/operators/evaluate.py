"""Scores of records and line events against ground truth."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import f1, fits, normalise_event, normalise_id, normalise_time, safe_div


def _column(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit("")


def truth_by_line(truth: DataFrame, n_lines: int) -> DataFrame:
    """line_index, event, aps (ApId and BSSID), clients of rows with a number under n_lines and a known event; ValueError where a number repeats."""
    if "OriginalLineIdx" not in truth.columns:
        raise ValueError("ground truth has no OriginalLineIdx")
    numbered = truth.withColumn("line_index", F.col("OriginalLineIdx").try_cast("double").cast("long")).where(F.col("line_index") < n_lines)
    if numbered.groupBy("line_index").count().where("count > 1").limit(1).count():
        raise ValueError("OriginalLineIdx repeats")
    present = lambda *c: F.array_distinct(F.filter(F.array(*[normalise_id(x) for x in c]), lambda v: v != ""))
    return numbered.select("line_index", normalise_event(F.col("Action")).alias("event"), present(_column(truth, "ApId"), _column(truth, "BSSID")).alias("aps"), present(_column(truth, "ClientId")).alias("clients")).where("event <> ''")


def metrics(matching: str, tp, fp, fn, flag, ap_ok, ap_all, client_ok, client_all, field_tp, n_truth, n_pred, client: bool) -> list:
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    ap, cl, fl = safe_div(ap_ok, ap_all), safe_div(client_ok, client_all), safe_div(flag, n_truth)
    fea = (ap + cl + fl) / 3.0 if client else (ap + fl) / 2.0
    counts = {"event_tp": tp, "event_fp": fp, "event_fn": fn, "field_tp": field_tp, "gt_events": n_truth, "pred_events": n_pred}
    return [F.lit(matching).alias("matching"), p.alias("event_precision"), r.alias("event_recall"), f1(p, r).alias("event_f1"), fea.alias("field_extraction_accuracy"), *[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in counts.items()]]


def by_line(events: DataFrame, rows: DataFrame, truth: DataFrame, n_lines: int, client: bool = True) -> DataFrame:
    """Scores by line number: one shuffle on it for truth, events and records."""
    gt = truth_by_line(truth, n_lines)
    pred = events.select("line_index", "event").where("line_index is not null").distinct()
    pairs = gt.select("line_index", "event", F.lit(1).alias("g")).join(pred.withColumn("p", F.lit(1)), ["line_index", "event"], "full")
    ev = pairs.agg(F.sum(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("tp"), F.count("p").alias("n_pred"), F.count("g").alias("n_truth"))
    last = rows.where("line_index is not null").groupBy("line_index").agg(F.max_by(F.struct(normalise_event(F.col("event")).alias("event"), normalise_id(F.col("ap_id")).alias("ap"), normalise_id(F.col("client_id")).alias("client")), "ts").alias("r"))
    one = pred.groupBy("line_index").agg(F.max("event").alias("p_event"))
    joined = gt.join(last, "line_index", "left").join(one, "line_index", "left")
    hit = lambda field, many: F.exists(many, lambda c: fits(F.coalesce(F.col(f"r.{field}"), F.lit("")), c))
    scored = joined.select("event", "p_event", F.col("r.event").alias("r_event"), F.size("aps").alias("na"), F.size("clients").alias("nc"), hit("ap", "aps").alias("ap"), hit("client", "clients").alias("cl"))
    number = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    whole = (F.col("r_event") == F.col("event")) & (F.col("na") > 0) & F.col("ap")
    whole = whole & (F.col("nc") > 0) & F.col("cl") if client else whole
    fl = scored.agg(number(F.col("p_event") == F.col("event")).alias("flag"), number(F.col("na") > 0).alias("ap_all"), number((F.col("na") > 0) & F.col("ap")).alias("ap_ok"), number(F.col("nc") > 0).alias("client_all"), number((F.col("nc") > 0) & F.col("cl")).alias("client_ok"), number(whole).alias("field_tp"))
    c = F.col
    return ev.crossJoin(fl).select(*metrics("line_index", c("tp"), c("n_pred") - c("tp"), c("n_truth") - c("tp"), c("flag"), c("ap_ok"), c("ap_all"), c("client_ok"), c("client_all"), c("field_tp"), c("n_truth"), c("n_pred"), client))


def truth_by_record(truth: DataFrame) -> DataFrame:
    """ts (to the second), event, ap, client, in file order where a column line_index or OriginalLineIdx tells it."""
    at = F.col("OriginalLineIdx").try_cast("double") if "OriginalLineIdx" in truth.columns else F.monotonically_increasing_id().cast("double")
    return truth.select(normalise_time(F.col("DateTime")).alias("ts"), normalise_event(F.col("Action")).alias("event"), normalise_id(_column(truth, "ApId")).alias("ap"), normalise_id(_column(truth, "ClientId")).alias("client"), at.alias("at")).where("event <> '' and ts <> ''")


def event_counts(events: DataFrame, gt: DataFrame) -> DataFrame:
    """ts, event, g, p: rows of each key in truth and prediction."""
    pred = events.select(normalise_time(F.col("ts")).alias("ts"), "event").where("ts <> '' and event <> ''").groupBy("ts", "event").agg(F.count("*").alias("p"))
    return gt.groupBy("ts", "event").agg(F.count("*").alias("g")).join(pred, ["ts", "event"], "full").select("ts", "event", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))


def _fits(p: str, t: str) -> bool:
    import re

    if not p or not t:
        return False
    a, b = re.sub("[^a-z0-9]", "", p), re.sub("[^a-z0-9]", "", t)
    return p in t or t in p or bool(a and b and (a in b or b in a))


def matched(truth: list[tuple], pred: list[tuple]) -> int:
    """Greedy one-to-one matches of tuples whose parts all fit: truth longest first, each takes the free prediction with most equal parts, the first of equals. Equal tuples are looked up;
    only a truth without one is compared with all that are free."""
    free = dict.fromkeys(range(len(pred)))
    equal: dict[tuple, deque] = defaultdict(deque)
    for k, p in enumerate(pred):
        equal[p].append(k)
    for t in sorted(truth, key=lambda x: -sum(map(len, x))):
        same = equal.get(t, ())
        while same and same[0] not in free:
            same.popleft()
        fits = [(0, same[0])] if same else [(-sum(a == b for a, b in zip(pred[k], t)), k) for k in free if all(map(_fits, pred[k], t))]
        if fits:
            del free[min(fits)[1]]
    return len(pred) - len(free)


def by_record(events: DataFrame, rows: DataFrame, truth: DataFrame, client: bool = True, extracted_only: bool = False) -> DataFrame:
    """Scores by second and event."""
    gt = truth_by_record(truth)
    ev = event_counts(events, gt).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"), F.sum("g").alias("n_truth"), F.sum("p").alias("n_pred"))
    pred = rows.select(normalise_time(F.col("ts")).alias("ts"), "event", normalise_id(F.col("ap_id")).alias("ap"), normalise_id(F.col("client_id")).alias("client"), F.col("line_index").cast("double").alias("at")).where("ts <> ''")
    fl = field_counts(gt, pred).agg(*[F.sum(c).alias(c) for c in ("ap_ok", "client_ok", "pair_ok", "ap_all", "client_all", "ap_min", "client_min")])
    c = F.col
    ap_all, client_all = (c("ap_min"), c("client_min")) if extracted_only else (c("ap_all"), c("client_all"))
    return ev.crossJoin(fl).select(*metrics("record", c("tp"), c("fp"), c("fn"), c("tp"), c("ap_ok"), ap_all, c("client_ok"), client_all, c("pair_ok") if client else c("ap_ok"), c("n_truth"), c("n_pred"), client))


def field_counts(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Of each (ts, event): matched and total ap, client and pair values. Values of a key, those of one second, are gathered into a row; Python takes many rows at a time."""
    import pyarrow as pa

    names = ["ap_ok", "client_ok", "pair_ok", "ap_all", "client_all", "ap_min", "client_min"]
    side = lambda df, name: df.groupBy("ts", "event").agg(F.sort_array(F.collect_list(F.struct("at", "ap", "client"))).alias(name))

    def counted(g: list[dict], p: list[dict]) -> list[int]:
        of = lambda rows, *parts: [v for v in (tuple(r[x] for x in parts) for r in rows) if all(v)]
        sides = [(of(g, *parts), of(p, *parts)) for parts in (("ap",), ("client",), ("ap", "client"))]
        return [*(matched(a, b) for a, b in sides), *(len(a) for a, _ in sides[:2]), *(min(len(a), len(b)) for a, b in sides[:2])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counted(g or [], p or []) for g, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]], names=["ts", "event", *names])

    both = side(gt, "g").join(side(pred, "p"), ["ts", "event"], "full").select("ts", "event", "g", "p")
    return both.mapInArrow(run, "ts string, event string, " + ", ".join(f"{n} long" for n in names))


def evaluate(events: DataFrame, rows: DataFrame, truth: DataFrame, n_lines: int, matching: str = "line_index", client: bool = True, extracted_only: bool = False, note: Callable[[str], None] = print) -> DataFrame:
    """By line number where asked for and possible, else by record."""
    if matching == "line_index":
        try:
            return by_line(events, rows, truth, n_lines, client)
        except ValueError as why:
            note(f"falling back to record matching: {why}")
    return by_record(events, rows, truth, client, extracted_only)
