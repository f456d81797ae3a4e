"""Sources of lines and of ground truth."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import local_table, ranked, shared_dir

#: What str.splitlines() splits on.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _valid(value: Column) -> Column:
    """Bytes that are not UTF-8 dropped; replacement characters that the file holds stay."""
    held = "\ufdd0\ufdd1\ufdd0"  # not characters: they stand for those while broken bytes become such ones
    kept = F.replace(value, F.lit("\ufffd"), F.lit(held))
    return F.when(F.is_valid_utf8(value), value).otherwise(F.replace(F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")), F.lit(held), F.lit("\ufffd")))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows(raw) of files, with line_index from 0 in the order of path and place.

    Ids rise by one within each part of a file that a task reads. A first pass counts each part's rows, which are few enough to add up; lines are not shuffled, and stay in the JVM."""
    rows = rows.select("raw", F.monotonically_increasing_id().alias("_id"), "_path", "_start")
    parts = rows.groupBy("_path", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_path", "_start", (before - F.col("_first")).alias("_offset"))
    return rows.join(offsets, ["_path", "_start"]).select((F.col("_id") + F.col("_offset")).alias("line_index"), "raw")


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_index (from 0, blank lines counted), raw: split at \\n alone, trailing \\r gone, bytes that are not UTF-8 dropped."""
    return _numbered(_scan(spark, path).select(F.regexp_replace(_valid(F.col("value")), r"\r+\z", "").alias("raw"), "_path", "_start"))


def lines_of(spark: SparkSession, lines: Iterable[str], most: int = 16 << 20) -> DataFrame:
    """line_index (from 0), raw of lines that the caller holds or makes one after another. Of more than most bytes (about; with 64 a line) the driver holds one piece at a time, which goes to the shared folder."""
    schema, piece, held, path = "line_index long, raw string", [], 0, ""
    for row in enumerate(lines):
        piece.append(row)
        held += 64 + len(row[1] or "")
        if held >= most:
            path = path or f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
            local_table(spark, piece, schema).write.mode("append").option("compression", "zstd").parquet(path)
            piece, held = [], 0
    if not path:
        return local_table(spark, piece, schema)
    if piece:
        local_table(spark, piece, schema).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file that is split as text is, not at \\n alone. Tasks read parts of it; a file that ends in another mark than \\n has an empty line more."""
    text = F.regexp_replace(_valid(F.col("value")), r"\r\z", "")
    return _numbered(_scan(spark, path).select(F.explode(F.split(text, LINE_ENDS)).alias("raw"), "_path", "_start"))


def sample_lines(lines: DataFrame, most: int = 20_000) -> DataFrame:
    """The first lines that are not blank."""
    return lines.where(F.trim("raw") != "").orderBy("line_index").limit(most)


def count_lines(lines: DataFrame) -> int:
    return lines.count()


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, empties as '', rows with too many fields skipped, short rows filled."""
    head = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in head) + ", _bad string, _more string"
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad").csv(path)
    return rows.where("_more is null").select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in head])


@dataclass(frozen=True)
class Settings:
    """Options of induction; the environment gives model and address, everything else comes from the configuration."""

    primary_model: str = ""
    fallback_models: tuple[str, ...] = ()
    base_url: str = ""
    batch_size: int = 8
    chunk_size: int = 50_000
    min_cluster_size: int = 1
    disable_fallback: bool = False
    request_timeout_seconds: float = 60.0
    max_retries: int = 2
    seed: int = 0

    @classmethod
    def load(cls, config: dict | None = None, env: dict[str, str] | None = None) -> Settings:
        held = dict((config or {}).get("llm", {}))
        env = dict(os.environ) if env is None else env
        known = {k: v for k, v in held.items() if k in cls.__dataclass_fields__}
        if "fallback_models" in known:
            known["fallback_models"] = tuple(read_list(known["fallback_models"]))
        out = cls(**known)
        out = replace(out, primary_model=env.get("ROAMSPARK_MODEL", out.primary_model), base_url=env.get("ROAMSPARK_BASE_URL", out.base_url))
        return replace(out, request_timeout_seconds=max(1.0, read_float(out.request_timeout_seconds, 60.0)), max_retries=max(0, read_int(out.max_retries, 2)), min_cluster_size=max(1, read_int(out.min_cluster_size, 1)), disable_fallback=read_bool(out.disable_fallback))


def read_bool(value: object, default: bool = False) -> bool:
    return default if value is None else str(value).strip().lower() in ("1", "true", "yes", "on")


def read_int(value: object, default: int) -> int:
    try:
        return int(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def read_float(value: object, default: float) -> float:
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def read_list(value: object) -> list[str]:
    items = value.split(",") if isinstance(value, str) else list(value or [])  # type: ignore[call-overload]
    return [x.strip() for x in items if str(x).strip()]


@dataclass
class Dataset:
    name: str
    log_path: str
    gt_path: str = ""
    matching: str = "line_index"
    exclude_client_in_fea: bool = False
    field_metrics_on_extracted_only: bool = False


@dataclass
class Experiment:
    settings: Settings
    datasets: list[Dataset] = field(default_factory=list)

    @classmethod
    def load(cls, path: str, only: list[str] | None = None) -> Experiment:
        """From a JSON file of the driver."""
        return cls.of(json.loads(Path(path).read_text(encoding="utf-8")), only)

    @classmethod
    def of(cls, held: dict, only: list[str] | None = None) -> Experiment:
        """only: names of the datasets to keep (an unknown name is an error)."""
        sets = [Dataset(**{k: v for k, v in d.items() if k in Dataset.__dataclass_fields__}) for d in held.get("datasets", [])]
        if only:
            if missing := set(only) - {d.name for d in sets}:
                raise ValueError(f"unknown datasets: {sorted(missing)}")
            sets = [d for d in sets if d.name in set(only)]
        return cls(Settings.load(held), sets)


def chunk_of(lines: DataFrame, size: int) -> DataFrame:
    """chunk (from 0) and place in it (from 1) of each line, by its number."""
    return lines.withColumns({"chunk": F.floor(F.col("line_index") / size), "fill": F.col("line_index") % size + 1})


def strided(lines: DataFrame, pool: int = 2000) -> DataFrame:
    """At most pool lines that are not blank, evenly spaced, without repeats, in order. Line numbers alone are ranked, in ranges; lines are read once chosen."""
    some = lines.where(F.trim("raw") != "").select("line_index", "raw")
    step = max(1, some.count() // pool)
    if step > 1:
        place = ranked(some.select("line_index"), "line_index", [], "_place").where((F.col("_place") % step == 0) & (F.col("_place") < pool * step)).select("line_index")
        some = some.join(F.broadcast(place), "line_index")  # at most pool numbers
    return some.groupBy("raw").agg(F.min("line_index").alias("line_index")).orderBy("line_index").limit(pool)
