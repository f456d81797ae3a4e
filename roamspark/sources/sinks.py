"""Sinks: JSON lines, pretty JSON, summary CSV, run folders, batched callbacks, progress."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..session import local_table

BATCH = 2000
#: Shares of a run's progress.
WEIGHTS = {"scan": 0.30, "induce": 0.40, "extract": 0.30}
SUMMARY = ["dataset", "matching", "event_precision", "event_recall", "event_f1", "field_extraction_accuracy", "event_tp", "event_fp", "event_fn", "field_tp", "gt_events", "pred_events", "lines", "groups", "records", "processed", "consolidated", "skipped", "llm_calls", "runtime_sec"]


def run_folder(root: str, dataset: str, run_id: str | None = None) -> str:
    return f"{root.rstrip('/')}/{run_id or datetime.now().strftime('%Y%m%d_%H%M%S')}/{dataset}"


def write_records(rows: DataFrame, path: str) -> None:
    """records.jsonl: a folder of JSON lines, UTF-8."""
    rows.write.mode("overwrite").json(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """One indented file, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray((json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n").encode()))
    finally:
        out.close()


def write_summary(spark, rows: list[dict], path: str) -> None:
    schema = ", ".join(f"{c} string" for c in SUMMARY)
    local_table(spark, [tuple(None if r.get(c) is None else str(r[c]) for c in SUMMARY) for r in rows], schema).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def batch_size(value: object) -> int:
    try:
        return max(1, int(value))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return BATCH


def batches(rows: DataFrame, size: object = BATCH) -> Iterator[list[dict]]:
    """Lists of at most size rows, one partition at a time; the last one may be short."""
    held: list[dict] = []
    n = batch_size(size)
    for r in rows.toLocalIterator(prefetchPartitions=True):
        held.append(r.asDict(recursive=True))
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def clamp(x: float) -> float:
    return min(1.0, max(0.0, x))


def weighted_fraction(stage: str, done: float) -> float:
    before = 0.0
    for name, share in WEIGHTS.items():
        if name == stage:
            return clamp(before + share * clamp(done))
        before += share
    return clamp(before)


def chunk_label(n: int, size: int) -> tuple[int, int]:
    """The chunk of the n-th line (from 1), and its place there."""
    return (max(n, 1) - 1) // size, (max(n, 1) - 1) % size + 1


class Progress:
    """Calls back at most once a second, never going back. Where lines are counted, the call says which chunk of them the last one is in."""

    def __init__(self, callback: Callable[[dict], None] | None, clock: Callable[[], float] = time.monotonic, chunk: int = 50_000):
        self.callback, self.clock, self.last, self.most, self.chunk = callback, clock, -1e9, 0.0, max(1, chunk)

    def __call__(self, stage: str, done: float, **more) -> None:
        self.most = max(self.most, weighted_fraction(stage, done))
        if self.callback and (self.clock() - self.last >= 1.0 or done >= 1.0):
            self.last = self.clock()
            if more.get("lines_processed"):
                index, fill = chunk_label(more["lines_processed"], self.chunk)
                more |= {"chunk_index": index, "chunk_fill": fill, "chunk_size": self.chunk, "phase": f"{stage} (chunk {index + 1} {fill}/{self.chunk})"}
            self.callback({"stage": stage, "file_fraction": self.most, **more})

    @contextmanager
    def watching(self, spark: SparkSession, stage: str, lines: int = 0, every: float = 1.0) -> Iterator[None]:
        """While the body runs a job, calls back with the share of its tasks that are done, and of lines, if their number is known."""
        if not self.callback:
            yield
            return
        over, tracker = threading.Event(), spark.sparkContext.statusTracker()

        def look() -> None:
            while not over.wait(every):
                found = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s))]
                if total := sum(i.numTasks for i in found):
                    done = sum(i.numCompletedTasks for i in found) / total
                    self(stage, min(done, 0.99), **({"lines_processed": int(done * lines)} if lines else {}))

        watcher = threading.Thread(target=look, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            over.set()
            watcher.join()
