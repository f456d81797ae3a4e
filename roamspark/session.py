"""Sessions, and what executors need from this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent


def local_session(cores: str = "*", app: str = "roamspark", conf: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=conf or {})
        .getOrCreate()
    )


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new folder of this machine in local mode (tests), and ValueError on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        at = _own_dirs.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="roamspark-")
        _own_dirs[app] = at
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, index: str, ties: list[str], name: str, step: int = 1 << 20) -> DataFrame:
    """df with name, its rank from 0 by the whole number index and ties. Rows are ranked within ranges of step and added to the number of rows before, so no task ranks all of them."""
    cell = F.floor(F.col(index) / step)
    sizes = df.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_n"))
    before = sizes.select("_cell", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each step
    own = F.row_number().over(Window.partitionBy("_cell").orderBy(index, *ties))
    return df.withColumn("_cell", cell).withColumn(name, own).join(before, "_cell").withColumn(name, F.col(name) + F.col("_before") - 1).drop("_cell", "_before")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table that stays in the JVM: through Arrow, so that no task has to start Python to read it."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=fields))


#: Rows and bytes of the batches that Python workers are sent, where the session has Spark's defaults: those hold 64 MB, several times in each of an executor's processes.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers once for each Spark application; on a cluster they have no copy of it. Batches are made small unless the session has set their size."""
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, ours)
    context = spark.sparkContext
    if getattr(context, "_roamspark_shipped", False):
        return
    at = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="roamspark-code-"), "roamspark_code.zip"))
    with zipfile.ZipFile(at, "w") as out:
        for path in sorted(ROOT.rglob("*.py")):
            out.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(at)
    context._roamspark_shipped = True
