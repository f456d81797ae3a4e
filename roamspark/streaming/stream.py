"""Records from a stream of lines: a static parser table joined to each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract, groups
from ..operators.header import HeaderRule
from ..sources.sinks import BATCH, batches


def stream_records(lines: DataFrame, rule: HeaderRule, table: DataFrame, keys: list[str] | None = None, ascii_only: bool = False) -> DataFrame:
    """Streaming lines(line_index, raw) to flat records; parsers stay what the table holds when the query starts."""
    return extract.records(groups.parsed_lines(lines, rule, keys, ascii_only), table)


def to_callback(rows: DataFrame, callback: Callable[[list[dict]], None], checkpoint: str, size: int = BATCH, once: bool = True) -> StreamingQuery:
    """Payload batches of at most size to a callback; the checkpoint folder keeps what was done."""

    def each(batch: DataFrame, _: int) -> None:
        for part in batches(extract.payload(batch), size):
            callback(part)

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events of each access point and window, late rows beyond the watermark left out."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "ap_id", "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "ap_id", "event", "n")
