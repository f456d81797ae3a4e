"""Micro-groups: lines of one skeleton, their counts and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fragment_keys, json_fragments, once, preprocess, skeleton, standardise
from ..session import ranked
from .header import HeaderRule, split_header

SAMPLE = 200


def kept(split: DataFrame) -> DataFrame:
    return split.where("status = 'success'")


def parsed_lines(lines: DataFrame, rule: HeaderRule, keys: list[str] | None = None, ascii_only: bool = False) -> DataFrame:
    """line_index, raw, ts, content (cleaned), skeleton of the lines whose header splits."""
    clean = once(kept(split_header(lines, rule)), content=preprocess(F.col("content")))
    if keys:
        clean = clean.withColumn("content", standardise(F.col("content"), keys))
    return once(clean, skeleton=skeleton(F.col("content"), ascii_only)).select("line_index", "raw", "ts", "content", "skeleton")


def json_keys(content_rows: DataFrame, most: int | None = 2000) -> list[str]:
    """Sorted distinct keys of flat fragments in the first most lines (None: in all)."""
    rows = content_rows if most is None else content_rows.orderBy("line_index").limit(most)
    got = key_rows(rows).agg(F.sort_array(F.collect_set("key")).alias("keys")).first()
    return list(got.keys or [])


def key_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("content").rlike(r"\{")).select(F.explode(json_fragments(F.col("content"))).alias("f")).select(F.explode(fragment_keys(F.col("f"))).alias("key"))


def micro_groups(lines: DataFrame) -> DataFrame:
    """skeleton, n, first_idx, representative (the first line), group_id by first appearance. Counts are summed before the shuffle, so a skeleton that most lines share costs one row a task."""
    got = lines.groupBy("skeleton").agg(F.count("*").alias("n"), F.min("line_index").alias("first_idx"), F.min_by("content", "line_index").alias("representative"))
    return ranked(got, "first_idx", ["skeleton"], "group_id")


def by_size(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("n"), "first_idx")


def eligible(groups: DataFrame, least: int) -> DataFrame:
    return groups.where(F.col("n") >= least)


def group_sample(lines: DataFrame, most: int = SAMPLE, order: Column | None = None, seed: int = 0) -> DataFrame:
    """At most most lines of each skeleton, by a seeded hash of the line number (or by order): the window keeps that many in each task before it shuffles."""
    order = F.xxhash64("line_index", F.lit(seed)) if order is None else order
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("skeleton").orderBy(order, "line_index"))).where(F.col("place") <= most)


def merge_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Groups of two scans as one: counts add up, the earlier first line and id stay, new skeletons get the next ids."""
    both = old.select("skeleton", "n", "first_idx", "representative", "group_id").unionByName(new.select("skeleton", "n", "first_idx", "representative", F.lit(None).cast("int").alias("group_id")))
    one = both.groupBy("skeleton").agg(F.sum("n").alias("n"), F.min_by("first_idx", F.coalesce("group_id", F.lit(2**31 - 1))).alias("first_idx"), F.min_by("representative", F.coalesce("group_id", F.lit(2**31 - 1))).alias("representative"), F.min("group_id").alias("held"))
    next_id = old.agg((F.coalesce(F.max("group_id"), F.lit(-1)) + 1).alias("next"))
    fresh = ranked(one.where("held is null"), "first_idx", ["skeleton"], "place").crossJoin(F.broadcast(next_id)).withColumn("group_id", F.col("place") + F.col("next"))  # one row
    columns = ["skeleton", "n", "first_idx", "representative"]
    return one.where("held is not null").select(*columns, F.col("held").cast("long").alias("group_id")).unionByName(fresh.select(*columns, F.col("group_id").cast("long").alias("group_id")))


def distinct_in_order(rows: DataFrame, column: str = "content") -> DataFrame:
    return rows.groupBy(column).agg(F.min("line_index").alias("line_index")).orderBy("line_index")
