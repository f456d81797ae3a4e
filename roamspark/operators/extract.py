"""Parsers applied to lines: lookup, captures, identifiers, records, line events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import CONNECT, DISCONNECT, iso_time, let, looks_like_mac, normalise_mac, pick_first
from ..functions.text import once
from ..session import local_table
from .templates import Parser

#: Parsers that are written into the plan, each pattern compiled once; above, patterns come from the joined table.
INLINE = 200
MAX_BROADCAST_PARSERS = 100_000
# fixed values: slots in the order in which they count
AP_NAMES = ["ap_ip", "ap_ip_1", "ap_ip_2", "ap_name", "ap_name_1", "ap_name_2", "ap", "ap_id"]
CLIENT_NAMES = ["client_ip_2", "client_ip_1", "client_ip", "client_name_2", "client_name_1", "client_name", "client", "client_id"]
TABLE = "skeleton string, group_id int, pattern string, names array<string>, flag int, example string"


def parser_table(spark: SparkSession, signature: dict[str, int], parsers: dict[int, Parser]) -> DataFrame:
    """One row for each skeleton whose group has a parser (or a label alone)."""
    rows = [(s, g, parsers[g].pattern, list(parsers[g].names), parsers[g].flag, parsers[g].example) for s, g in signature.items() if g in parsers]
    return local_table(spark, rows, TABLE)


def looked_up(lines: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Lines with their parser. The table is broadcast where it is small, which is counted; beyond that Spark joins by skeleton, and can split a hot one."""
    small = table.limit(MAX_BROADCAST_PARSERS + 1).count() <= MAX_BROADCAST_PARSERS
    return lines.join(F.broadcast(table) if small else table, "skeleton", how)


def captured(content: Column, parsers: list[Parser] | None = None, group: str = "group_id", by_group: dict[int, Parser] | None = None) -> Column:
    """fields: a map of names to captures that are not empty; one pass of the pattern over a line. by_group: parsers inline, else the columns pattern and names."""

    def taken(pattern: Column, n: Column | int, names: Column) -> Column:
        mark = F.expr("concat('\\u0002', array_join(transform(sequence(1, size(names)), i -> concat('$', i)), '\\u0001'))") if not isinstance(n, int) else F.lit("\u0002" + "\u0001".join(f"${i + 1}" for i in range(n)))
        x = F.when(~content.rlike("[\u0001\u0002]"), F.regexp_replace(content, pattern, mark))
        places = F.sequence(F.lit(1), F.size(names))
        slowly = F.when(F.regexp_like(content, pattern), _last_wins(names, F.transform(places, lambda k: F.regexp_extract_all(content, pattern, k)[0])))  # a pass for each capture, where the line holds a mark of its own
        fast = lambda v: F.when(v.startswith("\u0002"), _last_wins(names, F.split(F.substr(v, F.lit(2)), "\u0001", -1)))
        return F.element_at(F.transform(F.array(x), lambda v: F.when(v.isNotNull(), fast(v)).otherwise(slowly)), 1)  # the pattern runs once

    if by_group is None:
        return F.when(F.size("names") > 0, taken(F.col("pattern"), F.size("names"), F.col("names")))
    out = F.lit(None).cast("map<string,string>")
    for g, p in by_group.items():
        if p.pattern and p.names:
            out = F.when(F.col(group) == g, taken(F.lit(p.pattern), len(p.names), F.array(*map(F.lit, p.names)))).otherwise(out)
    return out


def _last_wins(names: Column, values: Column) -> Column:
    """Pairs whose value is not empty; of a repeated name the last that is kept as captured."""
    pairs = F.zip_with(names, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    last = F.filter(pairs, lambda p, i: F.array_position(F.transform(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"]), p["k"]) == 0)
    return F.map_from_entries(F.filter(last, lambda p: (p["v"].isNotNull()) & (p["v"] != "")))


def _field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def ap_id() -> Column:
    """The earliest MAC slot that is not blank, if it looks like a MAC; else address, name or id."""
    mac = pick_first(*[_field(n) for n in ("ap_mac", "ap_mac_1", "ap_mac_2")])
    return F.coalesce(let(mac, lambda m: F.when(looks_like_mac(m), normalise_mac(m))), pick_first(*[_field(n) for n in AP_NAMES]))


def client_id() -> Column:
    """The latest MAC slot that is not blank, whatever it looks like; else address, name or id."""
    mac = pick_first(*[_field(n) for n in ("client_mac_2", "client_mac_1", "client_mac")])
    return F.coalesce(normalise_mac(mac), pick_first(*[_field(n) for n in CLIENT_NAMES]))


def event_of(flag: Column) -> Column:
    return F.when(flag == 1, F.lit(CONNECT)).when(flag == -1, F.lit(DISCONNECT))


def with_fields(lines: DataFrame, table: DataFrame) -> DataFrame:
    """Lines of labelled groups with their captures. Groups of label 0 are gone before any pattern runs."""
    live = table.where("flag in (1, -1) and pattern is not null")
    rows = live.select("group_id", "pattern", "names", "flag").distinct().limit(INLINE + 1).collect()
    joined = looked_up(lines, live)
    if len(rows) <= INLINE:
        return once(joined, fields=captured(F.col("content"), by_group={r.group_id: Parser(r.pattern, tuple(r.names), r.flag) for r in rows}))
    return once(joined.sortWithinPartitions("group_id"), fields=captured(F.col("content")))  # successive lines share a compiled pattern


def records(lines: DataFrame, table: DataFrame, source: str = "header") -> DataFrame:
    """Flat records: line_index, ts, ap_id, client_id, event, flag, group_id, pattern, fields, raw_log."""
    got = once(with_fields(lines, table).where(F.col("fields").isNotNull() & (F.size("fields") > 0)), ap_id=ap_id(), client_id=client_id())
    return got.where("ap_id is not null and client_id is not null").select("line_index", "ts", "ap_id", "client_id", event_of(F.col("flag")).alias("event"), "flag", "group_id", "pattern", "fields", F.col("raw").alias("raw_log"), F.lit(source).alias("timestamp_source"))


def payload(rows: DataFrame) -> DataFrame:
    """Records in their outgoing shape."""
    meta = F.struct(F.col("flag").alias("connect_flag"), F.col("pattern").alias("regex"), "fields", F.col("group_id").alias("cluster_id"), "line_index", "timestamp_source")
    return rows.select("ap_id", "client_id", iso_time(F.col("ts")).alias("timestamp"), "event", "raw_log", meta.alias("metadata"))


def line_events(lines: DataFrame, table: DataFrame) -> DataFrame:
    """line_index, ts, event of every line whose group is labelled 1 or -1; captures are not asked for."""
    return looked_up(lines, table.where("flag in (1, -1)").select("skeleton", "flag")).select("line_index", "ts", event_of(F.col("flag")).alias("event"))


def events_of_records(rows: DataFrame) -> DataFrame:
    return rows.select("line_index", "ts", "event")


def lookup_stats(lines: DataFrame, table: DataFrame, weight: str | None = None) -> DataFrame:
    """hits, misses, patterns, total, hit_rate in percent (0 where there are no lines). weight: a column that says how many lines a row stands for."""
    n = F.lit(1) if weight is None else F.col(weight)
    number = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    got = looked_up(lines.select("skeleton", n.alias("_n")), table.select("skeleton", F.lit(1).alias("hit")), "left").agg(number(F.when(F.col("hit") == 1, F.col("_n"))).alias("hits"), number("_n").alias("total"))
    patterns = table.where("pattern is not null").agg(F.countDistinct("group_id").alias("patterns"))
    return got.crossJoin(patterns).select("hits", (F.col("total") - F.col("hits")).alias("misses"), "patterns", "total", F.when(F.col("total") > 0, 100.0 * F.col("hits") / F.col("total")).otherwise(0.0).alias("hit_rate"))
