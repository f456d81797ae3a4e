"""Packing: lexical retrieval packing with a sharded BM25 inverted index.

A document is its token ids and id 0. Its leading stretches of WINDOW ids are sequences of their own; the rest, fewer than WINDOW ids, is retrieved and packed:
within a shard of at most SHARD rests, an inverted index holds BM25 weights of the rests' distinct ids, and the seed, the first unused rest,
opens a window; the unused rests that BM25 ranks highest for it fill the window in turn, the last one being cut where the window ends; what is left of
that one is the next seed, first in its window. A shard's last, partly filled window is cut into pieces whose lengths are powers of two, each a sequence of its own, so that
nothing is padded.

Shards are lexical: rests are dealt into ranges of about RANGE shards by a 32-bit similarity hash of their ids (ties by a hash of the row, so that no hash value's share matters). Bounds of
the ranges are quantiles of the rows whose hash falls into a fixed part, so ranges, shards and what is packed together follow from the rows alone, not from how many tasks there are. A range
is read in order and every shard packed in bounded memory by one task.

Sequence ids: 2**62 marks packed windows; bits 36 and up are the range that made the sequence, or for whole windows the partition of the input, the lowest 36 bits number its sequences. A lost
task makes the same ids again.

Defined results: a null or empty text is the single id 0; repeated rows are packed as documents of their own, in any order among them; equal scores (ties) go by the order in the shard; null
ids are carried; an empty table gives no rows; columns besides id and text are neither read nor returned, whatever they are called; texts of any length are tokenized whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

WINDOW = 1024
SHARD = 1024
#: Shards of a range; rows that the bounds of ranges are taken from, about.
RANGE, SAMPLED = 8, 100_000
K1, B = 1.2, 0.75
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = [x.split()[0] for x in PIECE.split(", ")]
PACKED = 1 << 62


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write a byte that prints in Latin-1 as itself, the others as the signs from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(0x100 + k): b for k, b in enumerate(others)}


def encoder(path: str):
    """ids of texts; one tokenizer for each worker. A plain byte-level vocabulary whose ids rise with its merges is run by tiktoken, which gives the same ids three times as
    fast; texts that hold an added token's string, and all texts of any other vocabulary, go through tokenizers."""
    if path in _loaded:
        return _loaded[path]
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    by_slow = lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    added = [t["content"] for t in spec.get("added_tokens", [])]
    vocab = {k: v for k, v in model.get("vocab", {}).items() if k not in added}
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
    if not plain or len(vocab) != 256 + len(merges) or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        _loaded[path] = by_slow
        return by_slow
    import tiktoken

    sign = _byte_of_sign()
    fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks={bytes(sign[c] for c in k): v for k, v in vocab.items()}, special_tokens={})

    def by_both(texts: list[str]) -> list[list[int]]:
        return [by_slow([t])[0] if any(x in t for x in added) else fast.encode_ordinary(t) for t in texts]

    _loaded[path] = by_both
    return by_both


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def sketch(ids: np.ndarray) -> int:
    """A similarity hash of distinct ids."""
    h = kit.mix(np.unique(ids).astype(np.uint64) + np.uint64(0x51ED270B))
    bits = (h[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)
    return int(((2 * bits.sum(0) > len(h)).astype(np.int64) << np.arange(31, -1, -1)).sum())


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole windows as finished pieces, and each document's rest with its ids (little-endian unsigned 32-bit) and sketch."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)
        number = TaskContext.get().partitionId() << 36
        for b in batches:
            _, offs = kit.flat(b.column(1))
            for i, j in kit.chunks(offs):
                doc, out = [], [[] for _ in range(8)]
                for k, ids in enumerate(encode([t or "" for t in b.column(1).slice(i, j - i).to_pylist()])):
                    ids = np.array([*ids, 0], np.uint32)
                    whole = len(ids) // WINDOW * WINDOW
                    for start in range(0, whole, WINDOW):
                        for column, v in zip(out, (start, WINDOW, crc(ids[start : start + WINDOW]), len(ids), number, 0, None, None)):
                            column.append(v)
                        doc.append(k)
                        number += 1
                    if whole < len(ids):
                        rest = ids[whole:]
                        for column, v in zip(out, (whole, len(rest), None, len(ids), None, None, rest.astype("<u4").tobytes(), sketch(rest))):
                            column.append(v)
                        doc.append(k)
                ids_of = b.column(0).slice(i, j - i).take(pa.array(doc, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids_of, *[pa.array(c, pa.int64()) for c in out[:6]], pa.array(out[6], pa.binary()), pa.array(out[7], pa.int64())], names=["doc_id", *_PIECES, "ids", "sketch"])

    return rows.mapInArrow(kit.tidy(run), f"doc_id {kind}, {PIECE}, ids binary, sketch long")


class Index:
    """BM25 weights of a shard's rests, by id."""

    def __init__(self, rests: list[np.ndarray]):
        size = np.array([len(r) for r in rests])
        term = np.concatenate(rests).astype(np.int64)
        key, tf = np.unique(term * len(rests) + np.repeat(np.arange(len(rests)), size), return_counts=True)
        term, self.doc = np.divmod(key, len(rests))
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        self.first = np.append(first, len(key))
        idf = np.log1p((len(rests) - df + 0.5) / (df + 0.5))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / size.mean()))
        order = np.argsort(self.doc, kind="stable")  # each rest's terms, by place in self.terms
        self.of = np.repeat(np.arange(len(self.terms)), df)[order]
        self.bounds = np.searchsorted(self.doc[order], np.arange(len(rests) + 1))
        self.n = len(rests)

    def scores(self, doc: int) -> np.ndarray:
        """Of all rests, with the distinct ids of one as the query."""
        t = self.of[self.bounds[doc] : self.bounds[doc + 1]]
        n = self.first[t + 1] - self.first[t]
        at = np.repeat(self.first[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(rests: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (rest, start, length); every id of every rest is in exactly one piece."""
    if not rests:
        return []
    index, free = Index(rests), np.ones(len(rests), bool)
    out: list[list[tuple[int, int, int]]] = []
    seed, start, after = 0, 0, 0  # the seed's ids from start on are not yet packed
    free[0] = False
    while True:
        now, room = [], window
        ranked: Iterator[int] = iter(())
        doc, begin = seed, start
        asked = False
        while True:
            n = min(room, len(rests[doc]) - begin)
            now.append((doc, begin, n))
            room -= n
            if not room:
                begin += n
                break
            if not asked:
                s = np.where(free, index.scores(seed), -1.0)
                ranked, asked = iter(np.argsort(-s, kind="stable")), True
            doc = next((int(d) for d in ranked if free[d]), -1)
            if doc < 0:
                break
            free[doc], begin = False, 0
        if room:  # nothing is left to fill it: powers of two
            out.extend(_binary(now))
            return out
        out.append(now)
        if begin < len(rests[doc]):
            seed, start = doc, begin
            continue
        while after < len(rests) and not free[after]:
            after += 1
        if after == len(rests):
            return out
        seed, start = after, 0
        free[seed] = False


def _binary(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces dealt into sequences of falling powers of two."""
    left, out = sum(n for _, _, n in pieces), []
    todo = list(pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        now = []
        while room:
            doc, begin, n = todo.pop(0)
            take = min(n, room)
            now.append((doc, begin, take))
            room -= take
            if take < n:
                todo.insert(0, (doc, begin + take, n - take))
        out.append(now)
    return out


def ranged(rests: DataFrame, shard: int) -> DataFrame:
    """rests with key, and with range, which of the successive ranges of keys with about RANGE * shard rows each it is in; dealt by range."""
    key = F.shiftleft(F.col("sketch"), 31).bitwiseOR(F.xxhash64("ids", "doc_id").bitwiseAND((1 << 31) - 1))
    keyed = rests.withColumn("key", key)
    total = rests.count()
    n = max(1, -(-total // (RANGE * shard)))
    part = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(max(1, total // SAMPLED)))
    some = np.sort(keyed.where(part == 0).select("key").toArrow()["key"].to_numpy()) if n > 1 else np.zeros(0, np.int64)
    bounds = some[(np.arange(1, n) * len(some)) // n] if len(some) else np.zeros(0, np.int64)
    names = [*rests.columns, "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(bounds, b.column(len(names) - 1).to_numpy(), "right"))], names=[*names, "range"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    return keyed.mapInArrow(kit.tidy(run), f"{schema}, range long").select("doc_id", "start", "doc_tokens", "ids", "range", "key").repartition(n, "range")


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    made = kit.staged(tokenized(docs, path or tokenizer_path(), id_col, text_col), "tokenized")
    rests = made.where("ids is not null").select("doc_id", "start", "doc_tokens", "ids", "sketch")
    kind = made.schema["doc_id"].dataType.simpleString()
    dealt = ranged(rests, shard).sortWithinPartitions("range", "key", "doc_id", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = PACKED, -1
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal number
            rests = [np.frombuffer(r[3], "<u4") for r in held]
            out: list[list] = [[] for _ in range(7)]
            for sequence in pack_shard(rests):
                offset = 0
                for k, begin, size in sequence:
                    doc_id, start, total, _ = held[k]
                    for column, v in zip(out, (doc_id, start + begin, size, crc(rests[k][begin : begin + size]), total, number, offset)):
                        column.append(v)
                    offset += size
                number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], id_type), *[pa.array(c, pa.int64()) for c in out[1:]]], names=["doc_id", *_PIECES])

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for *row, part in zip(*(c.to_pylist() for c in b.columns[:5])):
                if part != own:
                    if held:
                        yield packed()
                    number, own = PACKED + (part << 36), part
                held.append(row)
                if len(held) == shard:
                    yield packed()
        if held:
            yield packed()

    rest = dealt.mapInArrow(kit.tidy(run), f"doc_id {kind}, {PIECE}")
    return made.where("ids is null").select("doc_id", *_PIECES).unionByName(rest)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(kit.read_table(spark, sf_dir, "documents"))
