"""Toxicity: a bidirectional gated recurrent network with attention pooling (gru.py) scores every overlapping window of every text.

A text's score is a calibrated probability from its highest window and the sum of all windows' odds. Windows are gru.WINDOW words, each gru.STRIDE words after the last, and cover all words.
Fitting takes the PER_CLASS labelled documents of each class with the least hash of their id, whole, in that order as long as they have FIT_BYTES of text; they train the network on the
driver.

Defined results: a null or blank text is one empty window, with the score that the network gives it; repeated rows are scored alike; without labels of
both classes every score is near the one class seen, or 0; null labels, and ids that are labelled with both classes, are not learned from; an empty table gives no rows; columns besides id
and text are neither read nor returned; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gru, kit

PER_CLASS, FIT_BYTES = 1500, 24 << 20
#: Distinct words whose gate inputs a worker holds between batches.
CACHE = 250_000


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> gru.Net:
    """labels holds only rows that may be learned from. At most 2 * per_class whole documents, of FIT_BYTES together, reach the driver."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    rows = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")
    by = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(parts[0].union(parts[1]))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").where("text is not null").select(F.col("text").cast("binary").alias("text"), "y", F.xxhash64("id").alias("h"), F.xxhash64("text").alias("t")).distinct()
    order = Window.orderBy("h", "t").rowsBetween(Window.unboundedPreceding, 0)  # the picked rows
    got = found.withColumn("total", F.sum(F.length("text")).over(order)).where(F.col("total") <= FIT_BYTES).orderBy("h", "t").collect()
    return gru.fit([bytes(r.text) for r in got], np.array([r.y for r in got]), by.get(1, 0) / max(sum(by.values()), 1))


class Scorer:
    def __init__(self, net: gru.Net):
        self.net = net
        self.keys, self.gates = np.zeros(0, np.uint64), np.zeros((0, 6 * gru.HIDDEN), np.float32)

    def texts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Of each row its score; data is lower case."""
        s, e, bounds = kit.tokens(data, offs)
        h = kit.span_hash(kit.prefix_hash(data), s, e)
        keys, first, rows = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        gates = np.zeros((max(len(keys), 1), 6 * gru.HIDDEN), np.float32)
        gates[: len(keys)][known] = self.gates[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            gates[new] = self.net.projected(self.net.inputs(*gru.word_features(data, s[first[new]], e[first[new]])))
            both, held = keys, gates[: len(keys)]
            if len(self.keys) + len(new) <= CACHE:
                both, held = np.concatenate([self.keys, keys[new]]), np.concatenate([self.gates, gates[new]])
            order = np.argsort(both)
            self.keys, self.gates = both[order], held[order]
        starts = [gru.windows(n) for n in np.diff(bounds)]
        doc = np.repeat(np.arange(len(starts)), [len(x) for x in starts])
        logit = gru.window_logits(self.net, gates, rows, bounds, doc, np.concatenate([np.asarray(x) for x in starts]))
        pooled = gru.pooled(logit, np.searchsorted(doc, np.arange(len(starts))))
        return gru._sigmoid(pooled @ self.net.pool[:-1] + self.net.pool[-1])


def score(docs: DataFrame, net: gru.Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            data, offs = kit.flat(b.column(1))
            for i, j in kit.chunks(offs):
                got = scorer.texts(kit.LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(got)], names=["doc_id", "score"])

    return rows.mapInArrow(kit.tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = kit.read_table(spark, sf_dir, "documents"), kit.read_table(spark, sf_dir, "labels")
    net = fit(docs, labels.where(kit.fold("doc_id", 5) != 0))
    return score(docs, net).select("doc_id", (kit.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
