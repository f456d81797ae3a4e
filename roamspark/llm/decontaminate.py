"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Normalising lower-cases A-Z and takes words, runs of bytes that are not ASCII or are digits or letters; a text is its words joined by
single spaces. Windows are WINDOW successive words of an item; an item of fewer words, but not none, is one window.
A document is scanned once; each match gives its word range, and the words' byte offsets map it to the original text.

The automaton is broadcast. Its size follows the benchmark, not the corpus, and is bounded: beyond MAX_WINDOWS windows these are
dealt into blocks by a hash, and the documents are scanned, and staged, a block at a time, so that no process holds two automata.

Defined results: null and wordless texts have no words and no hits; null and wordless items have no windows; equal windows of several items
count for each; a null item id is written as an empty text; repeated rows are scanned alike; matches that overlap are one range, and equal ranges of several windows (ties) one hit; empty tables give no rows or no hits; columns besides those named
and those of keep are neither read nor returned, whatever they are called; texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

WINDOW = 10
#: Windows in one automaton, about 1 KB each.
MAX_WINDOWS = 200_000
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TABLE = bytes((c + 32 if 65 <= c < 91 else c) if _WORD[c] else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    return [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


def automaton_of(patterns: dict[bytes, list[str]]):
    """Over patterns with a space at each side, as Latin-1 text, a character a byte; its values are (number of words, items)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for pattern, items in patterns.items():
        automaton.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, tuple(items)))
    if patterns:
        automaton.make_automaton()
    return automaton


def scan(text: bytes, automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """The number of words, the merged word ranges that any window covers, and the items of these windows."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    found = [(end, value) for end, value in automaton.iter(line)]
    if not found:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found])  # words before the space that ends the match
    ranges: list[list[int]] = []
    for end, start in sorted((int(e), int(e) - value[0]) for e, (_, value) in zip(last, found)):
        if ranges and start <= ranges[-1][1]:
            while len(ranges) > 1 and start <= ranges[-2][1]:
                ranges.pop()
            ranges[-1] = [min(start, ranges[-1][0]), end]
        else:
            ranges.append([start, end])
    return len(words), [(a, b) for a, b in ranges], {item for _, (_, items) in found for item in items}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def byte_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes of the original text that word ranges cover."""
    if not ranges:
        return []
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = kit.tokens(data, np.array([0, len(data)]), ~_WORD)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in ranges]


_PAIRS = ("array<struct<first:long,last:long>>", "array<struct<start:long,stop:long>>")
_PAIR = {k: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())])) for k, a, b in (("hits", "first", "last"), ("spans", "start", "stop"))}


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("text"))


def _number(items: DataFrame, max_windows: int) -> int:
    """Blocks into which the windows are dealt, so that none holds much more than max_windows: a text has at most a window for every other byte."""
    bound = items.agg(F.sum(F.greatest(F.lit(1), F.floor(F.coalesce(F.length("text"), F.lit(0)) / 2)))).first()[0] or 0
    return max(1, -(-int(bound) // max_windows))


def _block(items: DataFrame, k: int, n: int) -> dict[bytes, list[str]]:
    """The k-th of n blocks of windows, with their items; the benchmark passes by a partition at a time, so the driver holds one block alone."""
    patterns: dict[bytes, list[str]] = defaultdict(list)
    for item, text in items.toLocalIterator():
        for w in windows_of(words_of(bytes(text or b""))):
            if zlib.crc32(w) % n == k and item not in patterns[w]:
                patterns[w].append(item)
    return dict(patterns)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Each document's words, hit word ranges, the spans of original bytes that they cover, and the items found, sorted; keep: more columns to carry."""
    context = docs.sparkSession.sparkContext
    carried = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep or [])])
    out = carried.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.lit(None).cast(_PAIRS[0]), "spans": F.lit(None).cast(_PAIRS[1]), "items": F.lit(None).cast("array<string>")})
    items = _items(benchmark, item_col, item_text)
    n = _number(items, max_windows)
    for k in range(n):
        shared = context.broadcast(_block(items, k, n))
        out = out.mapInArrow(kit.tidy(_step(shared, k == 0, k == n - 1)), out.schema)
        if k < n - 1:  # the next block's automaton is made once this one is gone
            out = kit.staged(out, "scanned")
            shared.destroy()
    return out.select("doc_id", "n_words", "hits", "spans", "items", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep or [])])


def _step(patterns, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(patterns.value)
        for b in batches:
            at = {n: k for k, n in enumerate(b.schema.names)}
            n_words, hits, spans, items = [], [], [], []
            before = None if first else list(zip(b.column(at["hits"]).to_pylist(), b.column(at["items"]).to_pylist()))
            for k, text in enumerate(b.column(at["_text"]).cast(pa.large_string()).cast(pa.large_binary())):
                text = text.as_py() or b""
                n, ranges, found = scan(text, automaton)
                if before and before[k][0]:
                    ranges = merged(ranges + [(r["first"], r["last"]) for r in before[k][0]])
                    found |= set(before[k][1])
                n_words.append(n)
                hits.append([{"first": a, "last": z} for a, z in ranges])
                spans.append([{"start": a, "stop": z} for a, z in byte_spans(text, ranges)] if last else [])
                items.append(sorted(found))
            got = {"n_words": pa.array(n_words, pa.int64()), "hits": pa.array(hits, _PAIR["hits"]), "spans": pa.array(spans, _PAIR["spans"]), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([got.get(n, b.column(k)) for n, k in at.items()], names=list(at))

    return run


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(kit.read_table(spark, sf_dir, "documents"), kit.read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, r: total + r["last"] - r["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: The windows as SQL: every run of 10 words of an item, or all its words, sought in each document's words.
ORACLE = r"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
win AS (SELECT DISTINCT item, w[k:k + least(10, len(w)) - 1] AS words FROM item, range(1, greatest(len(w) - 9, 1) + 1) t(k) WHERE len(w) > 0),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
size AS (SELECT DISTINCT len(words) AS n FROM win),
place AS (SELECT doc_id, k, n, w[k:k + n - 1] AS words FROM doc, size, range(1, len(w) - n + 2) t(k) WHERE len(w) >= n),
found AS (SELECT doc_id, k, n, item FROM place JOIN win USING (words)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, range(k, k + n) t(j) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
