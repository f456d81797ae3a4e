"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words are runs without ASCII white space (0x20, 0x09-0x0D). Each word and each pair of successive words of a document,
A-Z in lower case, falls into one of 2**BITS buckets by a 64-bit hash. Two smoothed multinomials over the buckets, one of the
trusted documents and one of all documents, give each document the mean over its n-grams of log(p_trusted / p_raw).
A document is kept if it passes the base rules and this mean is at least THRESHOLD.

Defined results: a null or blank text has no words, scores 0 and fails the base rules; repeated rows are scored alike;
an empty table gives no rows; columns besides the id and the text are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

BITS = 18
#: Documents below this mean log ratio (nats an n-gram) are dropped.
THRESHOLD = -0.2
#: Added to each bucket's count in both multinomials, the raw one being scaled to the trusted total before.
SMOOTH = 3.0
#: At most so many trusted documents are fitted on, those with the least hash of their id; raw counts cover all documents.
MAX_TRUSTED = 20_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _grams(data: np.ndarray, offs: np.ndarray):
    """Word hashes, the bounds of each document's words, and the buckets of its words and of its pairs of words."""
    starts, ends, bounds = kit.tokens(data, offs)
    h = kit.span_hash(kit.prefix_hash(kit.LOWER[data]), starts, ends)
    one = (h >> np.uint64(64 - BITS)).astype(np.int64)
    pair = kit.mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) >> np.uint64(64 - BITS) if len(h) else h
    inner = np.ones(max(len(h) - 1, 0), bool)
    cut = bounds[1:-1]
    inner[cut[(cut > 0) & (cut < len(h))] - 1] = False
    return starts, ends, bounds, h, one, pair.astype(np.int64), inner


def bucket_counts(docs: DataFrame) -> DataFrame:
    """bucket, n_raw, n_trusted of docs(text, trusted); each task sends one row for each bucket it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for b in batches:
            data, offs = kit.flat(b.column(0))
            good = np.asarray(b.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for i, j in kit.chunks(offs):
                part = offs[i : j + 1] - offs[i]
                _, _, bounds, _, one, pair, inner = _grams(data[offs[i] : offs[j]], part)
                raw += np.bincount(one, minlength=1 << BITS) + np.bincount(pair[inner], minlength=1 << BITS)
                of = np.repeat(good[i:j], np.diff(bounds))
                trusted += np.bincount(one[of], minlength=1 << BITS) + np.bincount(pair[inner & of[:-1]], minlength=1 << BITS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], names=["bucket", "n_raw", "n_trusted"])

    return docs.select("text", "trusted").mapInArrow(kit.tidy(run), "bucket long, n_raw long, n_trusted long").groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_trusted").alias("n_trusted"))


def fit(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(p_trusted / p_raw) of each bucket. What reaches the driver is bounded by 2**BITS rows, the broadcast ids by MAX_TRUSTED."""
    ids = trusted_ids.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull()).distinct().orderBy(F.xxhash64("_id"), "_id").limit(MAX_TRUSTED)
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids.withColumn("trusted", F.lit(True))), "_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    got = bucket_counts(marked).toArrow()
    counts = np.zeros((2, 1 << BITS))
    counts[:, got["bucket"].to_numpy()] = got["n_raw"].to_numpy(), got["n_trusted"].to_numpy()
    return log_ratio(counts)


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Of counts[raw, trusted]; without trusted n-grams all ratios are 0."""
    raw, trusted = counts
    if not raw.sum() or not trusted.sum():
        return np.zeros(len(raw), np.float32)
    return np.log((trusted + SMOOTH) / (raw * (trusted.sum() / raw.sum()) + SMOOTH)).astype(np.float32)


def line_repeats(text: str) -> int:
    """\\n-split lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(" \t\n\x0b\x0c\r"))


def repeated_words(words: list[bytes]) -> int:
    """Words in 5-word windows that are found twice or more, the first included."""
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n, hit = Counter(windows), bytearray(len(words))
    for k, w in enumerate(windows):
        if n[w] > 1:
            hit[k : k + 5] = b"\1" * 5
    return sum(hit)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, log_ratio double"


def measure(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The base counts, the mean log ratio and the verdict of each document."""
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(ratios)  # 2**BITS floats
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = out.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lr = table.value
        for b in batches:
            data, offs = kit.flat(b.column(1))
            texts = b.column(1)
            for i, j in kit.chunks(offs):
                part, own = offs[i : j + 1] - offs[i], data[offs[i] : offs[j]]
                starts, ends, bounds, h, one, pair, inner = _grams(own, part)
                n_words = np.diff(bounds)
                points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                word_chars = kit.sums(points[ends] - points[starts], bounds)
                symbols = np.concatenate([[0], np.cumsum(SYMBOLS[own])])
                n_symbols = symbols[part[1:]] - symbols[part[:-1]]
                score = kit.sums(lr[one].astype(np.float64), bounds)
                score += kit.sums(np.append(np.where(inner, lr[pair], 0), 0.0)[: len(h)].astype(np.float64), bounds)
                score /= np.maximum(2 * n_words - 1, 1)
                dup_lines = np.array([line_repeats(t) if t else 0 for t in texts.slice(i, j - i).to_pylist()], np.int64)
                repeat = np.zeros(j - i, np.int64)
                for k in np.flatnonzero(_has_repeats(h, bounds)):  # the exact count, where hashes say that there may be one
                    repeat[k] = repeated_words([own[s:e].tobytes() for s, e in zip(starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]])])
                failed = (n_words < 10) | (100 * repeat > 20 * n_words)
                cols = [n_words, word_chars, n_symbols, dup_lines, repeat, failed, ~failed & (score >= threshold), score]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *map(pa.array, cols)], names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    return out.mapInArrow(kit.tidy(run), f"doc_id {id_type}, {SCHEMA}")


def _has_repeats(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document, if two of its 5-word windows have the same hash."""
    n = len(bounds) - 1
    if len(h) < 6:
        return np.zeros(n, bool)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    w = h[:-4].copy()
    for k in range(1, 5):
        w = kit.mix(w * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : len(h) - 4 + k])
    whole = doc[:-4] == doc[4:]
    w, d = kit.mix(w[whole] + doc[:-4][whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), doc[:-4][whole]
    order = np.argsort(w)
    same = w[order][1:] == w[order][:-1]
    out = np.zeros(n, bool)
    out[d[order[1:][same]]] = True
    return out


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = kit.read_table(spark, sf_dir, "documents"), kit.read_table(spark, sf_dir, "labels")
    return measure(docs, fit(docs, labels.where("quality = 1")))


def quality_base(spark, sf_dir: str) -> DataFrame:
    """The columns of op10_quality that do not depend on the model."""
    return op10_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n_dup_lines FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line) AS place, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE place > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, array_to_string(w[k:k + 4], ' ')) AS n FROM d, range(1, len(w) - 3) r(k) WHERE len(w) >= 5),
m AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM g, range(k, k + 5) r(j) WHERE n > 1 GROUP BY 1),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
"""
