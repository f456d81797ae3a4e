"""Flows between access points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transitions(rows: DataFrame) -> DataFrame:
    """from_ap, to_ap, n: successive connects of a client at different access points. Each hour of a client is a window of its own, whose first connect follows the last of the client's hour
    before, so that a busy client is dealt to many tasks."""
    moves = rows.where("event = 'connect'").select("client_id", "ap_id", "ts", "line_index", F.date_trunc("hour", "ts").alias("hour"))
    inside = moves.select("ap_id", F.lag("ap_id").over(Window.partitionBy("client_id", "hour").orderBy("ts", "line_index")).alias("from_ap"))
    place = F.struct("ts", "line_index")
    hours = moves.groupBy("client_id", "hour").agg(F.min_by("ap_id", place).alias("ap_id"), F.max_by("ap_id", place).alias("last"))
    between = hours.select("ap_id", F.lag("last").over(Window.partitionBy("client_id").orderBy("hour")).alias("from_ap"))
    both = inside.unionByName(between).where("from_ap is not null and from_ap <> ap_id")
    return both.groupBy("from_ap", F.col("ap_id").alias("to_ap")).agg(F.count("*").alias("n"))


def hotspots(rows: DataFrame) -> DataFrame:
    """ap_id, connects, clients."""
    return rows.where("event = 'connect'").groupBy("ap_id").agg(F.count("*").alias("connects"), F.countDistinct("client_id").alias("clients"))
