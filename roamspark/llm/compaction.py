"""Sharding: size-tiered compaction of small immutable shards, in DataFrame operations alone.

append() writes what arrives as small shards, one for each block of ARRIVAL ids and writing task, without a shuffle. plan() groups shard sizes into runs: a run's tier counts how often
its bytes, from BASE on, grew FAN-fold; FAN successive runs of one tier and domain merge, round by round, until runs hold TARGET bytes or no tier has FAN smaller ones. Domains are
DOMAIN successive arrivals, so that no window over shard sizes grows with the table. compact() rewrites the rows of merged runs once, a run
being cut into files of TARGET bytes in the order of their rows; runs that did not merge stay where they are.

A manifest is a table of the live files (path, run, file, rows, bytes, id range), read from the files themselves. commit() writes it beside and renames it to its version's name; the
rename fails where that version exists, so of two writers one has to plan again, and readers see a whole manifest or none. Files that no manifest names are
left for vacuum(); no file is ever changed.

Defined results: a null or empty text has no bytes; a null id arrives in block 0; repeated rows are kept, each once; an empty table gives an empty manifest; columns of the table are all kept,
so the names arrival, run, file and n_bytes must be free (ValueError otherwise); a text longer than TARGET has a file with what precedes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kit

#: Ids to an arrival.
ARRIVAL = 256
#: Bytes of text: least size of tier 1, runs of a tier that merge, size of a finished run and of a file.
BASE, FAN, TARGET = 1 << 20, 4, 16 << 20
DOMAIN = 4096
OWN = ("arrival", "run", "file", "n_bytes")


def tiers(base: int = BASE, fan: int = FAN, target: int = TARGET) -> list[int]:
    """The sizes at which tiers begin."""
    out, size = [], base
    while size < target:
        out.append(size)
        size *= fan
    return [*out, target]


def sized(docs: DataFrame, id_col: str, text_col: str, arrival: int) -> DataFrame:
    if held := set(OWN) & set(docs.columns):
        raise ValueError(f"columns {sorted(held)} are written by the operator")
    return docs.withColumns({"arrival": F.floor(F.coalesce(F.col(id_col), F.lit(0)) / arrival), "n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")})


def append(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", arrival: int = ARRIVAL) -> DataFrame:
    """Writes docs as small shards and returns them as read back."""
    sized(docs, id_col, text_col, arrival).write.mode("append").option("compression", "zstd").partitionBy("arrival").parquet(f"{root}/arrivals")
    return shards(docs.sparkSession, f"{root}/arrivals", sized(docs, id_col, text_col, arrival))


def shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def plan(sizes: DataFrame, base: int = BASE, fan: int = FAN, target: int = TARGET, domain: int = DOMAIN) -> DataFrame:
    """arrival, n_bytes, run (its first arrival), arrivals (of the run), of sizes(arrival, n_bytes): one row a shard, never a document. Rounds go on until one merges nothing; each is
    staged, so that a plan is one round long."""
    now = kit.staged(sizes.select("arrival", "n_bytes", F.col("arrival").alias("run")), "runs")
    steps = tiers(base, fan, target)
    while True:
        runs = now.groupBy("run").agg(F.sum("n_bytes").alias("size"))
        tier = sum((F.col("size") >= s).cast("int") for s in steps)
        runs = runs.select("run", F.floor(F.col("run") / domain).alias("d"), tier.alias("tier"))
        at = Window.partitionBy("d", "tier").orderBy("run")
        group = runs.withColumn("g", F.floor((F.row_number().over(at) - 1) / fan))
        whole = Window.partitionBy("d", "tier", "g")
        merged = group.withColumns({"k": F.count("*").over(whole), "into": F.min("run").over(whole)})
        moved = merged.select("run", F.when((F.col("tier") < len(steps)) & (F.col("k") == fan), F.col("into")).otherwise(F.col("run")).alias("into"))
        moved = kit.staged(moved.where("run <> into"), "moved")
        if not moved.limit(1).count():
            break
        now = kit.staged(now.join(moved, "run", "left").select("arrival", "n_bytes", F.coalesce("into", "run").alias("run")), "runs")
    return now.withColumn("arrivals", F.count("*").over(Window.partitionBy("run")))


def compact(held: DataFrame, runs: DataFrame, root: str, id_col: str = "doc_id", target: int = TARGET) -> str:
    """Rewrites the rows of runs that hold several arrivals; returns the folder."""
    out = f"{root}/merged-{uuid.uuid4().hex}"
    moving = held.join(runs.where("arrivals > 1").select("arrival", "run"), "arrival")
    before = Window.partitionBy("run").orderBy("arrival", id_col, F.xxhash64(*[c for c in held.columns])).rowsBetween(Window.unboundedPreceding, -1)
    cut = moving.withColumn("file", F.floor(F.coalesce(F.sum("n_bytes").over(before), F.lit(0)) / target))
    cut.write.option("compression", "zstd").partitionBy("run", "file").parquet(out)
    return out


def commit(manifest: DataFrame, root: str, version: int) -> str:
    """Writes a manifest and gives it its version's name in one rename; FileExistsError if another writer has taken the version."""
    spark = manifest.sparkSession
    waiting, final = f"{root}/manifests/.waiting-{uuid.uuid4().hex}", f"{root}/manifests/v{version:010d}"
    manifest.write.parquet(waiting)
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(waiting), jvm.org.apache.hadoop.fs.Path(final)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(source, target) or fs.exists(jvm.org.apache.hadoop.fs.Path(f"{final}/{source.getName()}")):
        fs.delete(source, True)
        raise FileExistsError(final)
    return final


def latest(spark: SparkSession, root: str) -> int:
    """The newest committed version, 0 if there is none."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return max((int(n[1:]) for n in names if n.startswith("v")), default=0)


def described(rows: DataFrame, id_col: str) -> DataFrame:
    """A manifest row of each file that holds rows(path, run, file, n_bytes)."""
    return rows.groupBy("path", "run", "file").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id"))


def read_manifest(spark: SparkSession, root: str, like: DataFrame, version: int | None = None) -> DataFrame:
    """The rows of a version's live files, with arrival, run and file. The manifest's paths reach the driver, one for each file, as a reader's file list does."""
    live = spark.read.parquet(f"{root}/manifests/v{version or latest(spark, root):010d}")
    out = None
    for merged in (False, True):
        paths = [r.path for r in live.where(F.col("path").contains("/merged-") == merged).select("path").collect()]
        if paths:
            base = paths[0][: paths[0].index("/merged-") + 40] if merged else f"{root}/arrivals"
            names = ("run long, file long" if merged else "arrival long")
            schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema if merged or f.name != "arrival"], names])
            rows = spark.read.schema(schema).option("basePath", base).parquet(*paths)
            rows = rows if merged else rows.withColumns({"run": F.col("arrival"), "file": F.lit(0).cast("long")})
            rows = rows.select(*like.columns, "run", "file")
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], like.schema).withColumns({"run": F.lit(0).cast("long"), "file": F.lit(0).cast("long")})


def shard_table(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", arrival: int = ARRIVAL, base: int = BASE, fan: int = FAN, target: int = TARGET) -> DataFrame:
    """Appends, commits, compacts, commits, and returns the rows as the last manifest has them, with arrival, run, file and n_bytes."""
    spark = docs.sparkSession
    held = append(docs, root, id_col, text_col, arrival)
    alone = lambda rows: described(rows.withColumns({"run": F.col("arrival"), "file": F.lit(0).cast("long")}), id_col)
    version = latest(spark, root)
    placed = held.withColumn("path", F.col("_metadata.file_path"))
    commit(alone(placed), root, version + 1)
    runs = kit.staged(plan(held.groupBy("arrival").agg(F.sum("n_bytes").alias("n_bytes")), base, fan, target), "runs")
    merged = compact(held, runs, root, id_col, target)
    files = alone(placed.join(runs.where("arrivals = 1").select("arrival"), "arrival"))
    if runs.where("arrivals > 1").limit(1).count():
        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema], "run long, file long"])
        files = files.unionByName(described(spark.read.schema(schema).parquet(merged).withColumn("path", F.col("_metadata.file_path")), id_col))
    commit(files, root, version + 2)
    return read_manifest(spark, root, held, version + 2)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes the files that none of the newest keep manifests names; returns how many."""
    jvm, newest = spark._jvm, latest(spark, root)
    live = None
    for v in range(max(1, newest - keep + 1), newest + 1):
        part = spark.read.parquet(f"{root}/manifests/v{v:010d}").select("path")
        live = part if live is None else live.union(part)
    if live is None:
        return 0
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{root}/arrivals", *_merged(spark, root)]).select("path")
    named = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    gone = [r.path for r in found.select(named("path").alias("path")).join(live.select(named("path").alias("path")).distinct(), "path", "left_anti").toLocalIterator()]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    return len(gone)


def _merged(spark: SparkSession, root: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f"{root}/{s.getPath().getName()}" for s in fs.listStatus(folder) if s.getPath().getName().startswith("merged-")]


def op6_compaction(spark, sf_dir: str) -> DataFrame:
    rows = shard_table(kit.read_table(spark, sf_dir, "documents"), f"{kit.shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    return rows.select("doc_id", F.col("arrival").cast("long").alias("arrival"), F.col("run").cast("long").alias("run"), F.col("file").cast("long").alias("file"), "n_bytes", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: Rounds that the SQL spells out, more than any domain needs: a round leaves a quarter of the runs of a tier and three at most, and a run rises through the tiers but once.
ROUNDS = 12


def _oracle() -> str:
    steps = tiers()
    parts = [f"s0 AS (SELECT coalesce(doc_id, 0) // {ARRIVAL} AS arrival, coalesce(doc_id, 0) // {ARRIVAL} AS run, sum(coalesce(strlen(text), 0)) AS n_bytes FROM documents GROUP BY 1, 2)"]
    tier = " + ".join(f"CAST(size >= {s} AS INT)" for s in steps)
    for k in range(ROUNDS):
        parts += [
            f"r{k} AS (SELECT run, run // {DOMAIN} AS d, {tier} AS tier FROM (SELECT run, sum(n_bytes) AS size FROM s{k} GROUP BY run))",
            f"g{k} AS (SELECT *, (row_number() OVER (PARTITION BY d, tier ORDER BY run) - 1) // {FAN} AS g FROM r{k})",
            f"m{k} AS (SELECT run, CASE WHEN tier < {len(steps)} AND count(*) OVER w = {FAN} THEN min(run) OVER w ELSE run END AS target FROM g{k} WINDOW w AS (PARTITION BY d, tier, g))",
            f"s{k + 1} AS (SELECT arrival, n_bytes, target AS run FROM s{k} JOIN m{k} USING (run))",
        ]
    last = f"s{ROUNDS}"
    return f"""WITH {", ".join(parts)},
doc AS (SELECT doc_id, coalesce(doc_id, 0) // {ARRIVAL} AS arrival, coalesce(strlen(text), 0) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
put AS (SELECT doc.*, run, count(DISTINCT doc.arrival) OVER (PARTITION BY run) AS arrivals, coalesce(sum(doc.n_bytes) OVER (PARTITION BY run ORDER BY doc.arrival, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM doc JOIN {last} USING (arrival))
SELECT doc_id, arrival, run, CAST(CASE WHEN arrivals > 1 THEN before // {TARGET} ELSE 0 END AS BIGINT) AS file, CAST(n_bytes AS BIGINT) AS n_bytes, text_sha256 FROM put"""


ORACLE = _oracle()
