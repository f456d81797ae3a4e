"""Suffix-array dedup: bytes of 100-byte strings that also start earlier are removed.

Order is (doc_id, start). Blocks: each window of LENGTH bytes names the least K-gram in it by hash (the leftmost of equals), its anchor. Equal windows name equal anchors at equal
offsets, so all suffixes that can share LENGTH bytes meet in the block of one anchor, and blocks are sorted one at a time (suffixes.py: difference cover).
Successive windows with one anchor are a context, at most 2 LENGTH bytes.

1. Each task cuts its texts into contexts, keeps the first of equal ones (by two 64-bit hashes), and marks the others: all their windows start earlier too.
2. By anchor: the first of equal contexts over all tasks stays, the others are marked. Only where an anchor has different contexts are these fetched.
3. By document: texts (compressed) meet marks and requests. Documents without requests are done; the others send the asked contexts.
4. By anchor: blocks are sorted; of each class of equal windows all but the first are marked. An anchor with over HOT contexts is dealt to several tasks; the windows that each
   of them leaves first meet once more, by the window's hash.
5. By document: the open documents meet the marks of 4.

An anchor that has over HOT contexts in one task of 1 goes to 4 directly, dealt to many tasks, so that no task of 2 or 4 holds all contexts of a hot anchor.

No step holds more than one task's share; marks follow the repeated bytes. In steps 1 and 2 a context's bytes are stood for by 64 bits of hash beside the 64 of its anchor's, in the last
part of 4 a window's by two of 64 bits; only between different contexts of one anchor are bytes themselves sorted.

Defined results: a null text has no bytes; texts under LENGTH bytes lose nothing; texts of any length are read whole, in pieces that overlap by a window; equal strings (ties) are ordered
by (doc_id, start); rows that repeat both id and text are one document, and each returns its result; rows that repeat an id with other texts are ordered by a 64-bit hash of the text
(ValueError if two of one id have the same); a null id comes first; empty tables give no rows; ids are integers; columns besides id and text are returned only where carry names them,
whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit, suffixes

LENGTH = 100
K = 31
SPAN = LENGTH - K + 1  # K-grams of a window
#: Contexts of one anchor that one task sorts.
HOT = 4096
#: Windows that are sorted at once, about 300 bytes of memory each.
BLOCK = 150_000
#: Bytes that are cut at once, about 100 bytes of memory each.
PIECE = 1 << 18
#: Contexts that a task gathers before it sends them on.
HELD = 200_000
U64 = np.uint64
CONTEXT = np.dtype([("h", "<u8"), ("f", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("at", "<u4"), ("a", "u1"), ("n", "u1")])
ASK = np.dtype([("h", "<u8"), ("at", "<u4"), ("a", "u1"), ("n", "u1"), ("salt", "<u2")])
MARK = np.dtype([("at", "<u4"), ("end", "<u4")])
FIRST = np.dtype([("x", "<u8"), ("y", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("at", "<u4")])
SALTS = 65535  # parts of an anchor, at most
SPLIT = 255  # n of a context that only says that its anchor is split


def contexts_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each context: row, start in the row, anchor's offset, windows less one, anchor hash, context hash. Texts are taken in pieces of about PIECE bytes."""
    out: list[tuple] = []
    for i, j in kit.chunks(offs, PIECE):
        low, high = int(offs[i]), int(offs[j])
        for begin in range(low, max(high - LENGTH, low) + 1, PIECE):
            end = min(high, begin + PIECE + LENGTH - 1)
            if end - begin >= LENGTH:
                out.append(_piece(data[begin:end], begin, offs[i : j + 1], i))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64, U64))
    return tuple(np.concatenate(c) for c in zip(*out))


def _piece(data: np.ndarray, begin: int, offs: np.ndarray, row: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    sums = kit.prefix_hash(data)
    inv = kit.powers(n + 1)[1]
    h = kit.mix((sums[K:] - sums[:-K]) * inv[: n - K + 1])
    least = (h & ~U64((1 << 21) - 1)) | np.arange(len(h), dtype=U64)
    size = 1
    while size * 2 <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])[: n - LENGTH + 1]
    anchor = (least & U64((1 << 21) - 1)).astype(np.int64)
    p = np.arange(len(anchor))
    doc = np.searchsorted(offs, begin + p, "right") - 1
    inside = begin + p + LENGTH <= offs[np.minimum(doc + 1, len(offs) - 1)]
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    good = inside[first]
    first, last = first[good], last[good]
    a = anchor[first]
    f = kit.mix(kit.span_hash(sums, first, last + LENGTH) + (a - first).astype(U64) * U64(0x9E3779B97F4A7C15))
    return row + doc[first], begin + first - offs[doc[first]], a - first, last - first, h[a], f


def firsts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in the order of anchor, context hash and place, without exact repeats; of each whether it is the first of equal ones."""
    c = c[np.lexsort((c["at"], c["th"], c["doc"], c["f"], c["h"]))]
    same = (c["h"][1:] == c["h"][:-1]) & (c["f"][1:] == c["f"][:-1])
    twice = same & (c["doc"][1:] == c["doc"][:-1]) & (c["th"][1:] == c["th"][:-1]) & (c["at"][1:] == c["at"][:-1])
    keep = np.concatenate([[True], ~twice])[: len(c)]
    first = np.concatenate([[True], ~same])[: len(c)]
    return c[keep], first[keep]


def joined(at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals."""
    if not len(at):
        return at, end
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], at[1:] > end[:-1]])
    return at[new], end[np.append(np.flatnonzero(new)[1:], len(at)) - 1]


def planes(rows: np.ndarray, packer: zstandard.ZstdCompressor) -> bytes:
    """Records by byte plane, compressed: ids and places are mostly zeros in their high bytes."""
    return packer.compress(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1).T.tobytes())


def from_planes(raw: bytes, kind: np.dtype, opener: zstandard.ZstdDecompressor) -> np.ndarray:
    body = np.frombuffer(opener.decompress(raw), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(body.T).view(kind).ravel()


_MIXED = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("kind", pa.int8()), ("payload", pa.binary())])
_BUCKETS = pa.schema([("bucket", pa.int64()), ("payload", pa.binary())])
MARKS, ASKS, TEXT = 0, 1, 2  # in this order, so that texts need not be held


def _by_doc(doc: np.ndarray, th: np.ndarray, rows: np.ndarray, kind: int) -> pa.RecordBatch:
    """rows packed into one payload for each document."""
    order = np.lexsort((th, doc))
    doc, th, rows = doc[order], th[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])])[: len(doc)])
    ends = np.append(first[1:], len(doc))
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(th[first].astype(np.int64)), pa.array(np.full(len(first), kind, np.int8)), pa.array([rows[s:e].tobytes() for s, e in zip(first, ends)], pa.binary())], schema=_MIXED)


def _marks(doc: np.ndarray, th: np.ndarray, at: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Marks by document, touching ones of a document joined."""
    order = np.lexsort((at, th, doc))
    doc, th, at, end = doc[order], th[order], at[order].astype(np.int64), end[order].astype(np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])])[: len(doc)]
    shift = np.cumsum(new) * (1 << 33)
    a, e = joined(at + shift, end + shift)
    where = np.searchsorted(at + shift, a)
    rows = np.zeros(len(a), MARK)
    rows["at"], rows["end"] = a - shift[where], e - shift[where]
    return _by_doc(doc[where], th[where], rows, MARKS)


def _bucketed(key: np.ndarray, payloads, n: int) -> pa.RecordBatch:
    """One row for each bucket of keys; payloads(rows) gives the bytes."""
    bucket = (kit.mix(key + U64(0x51ED270B)) % U64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)])
    return pa.RecordBatch.from_arrays([pa.array(ranked[first]), pa.array([payloads(rows) for rows in np.split(order, first[1:])] if len(order) else [], pa.binary())], schema=_BUCKETS)


def _asks(c: np.ndarray, salts: np.ndarray) -> pa.RecordBatch:
    """Requests for the bytes of contexts by document; salts: into how many parts each one's anchor is dealt."""
    ask = np.zeros(len(c), ASK)
    for name in ("h", "at", "a", "n"):
        ask[name] = c[name]
    ask["salt"] = np.where(salts > 1, 1 + kit.mix(c["doc"].astype(U64) + c["at"]) % np.maximum(salts, 1).astype(U64), 0)
    return _by_doc(c["doc"], c["th"], ask, ASKS)


def _sizes(h: np.ndarray) -> np.ndarray:
    """Of each of sorted anchors how many contexts it has here."""
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    n = np.diff(np.append(edge, len(h)))
    return np.repeat(n, n)


def cut(docs: DataFrame, buckets: int, repeated: bool) -> DataFrame:
    """Step 1 on docs(id, text): contexts by bucket of their anchor, marks, and requests of anchors that are hot here. repeated: whether an id has several rows."""
    hot = HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        packer = zstandard.ZstdCompressor(level=1)

        def sent() -> Iterator[pa.RecordBatch]:
            c, first = firsts(np.concatenate(held))
            again = c[~first]
            if len(again):
                m = _marks(again["doc"], again["th"], again["at"], again["at"] + again["n"].astype(np.int64) + LENGTH)
                yield _wide(None, m)
            c = c[first]
            many = _sizes(c["h"]) > hot
            if many.any():
                yield _wide(None, _asks(c[many], np.full(int(many.sum()), SALTS)))
                told = c[many][np.concatenate([[True], np.diff(c["h"][many]) != 0])]
                told["n"] = SPLIT
                c = np.concatenate([c[~many], told])
            yield _wide(_bucketed(c["h"], lambda rows: planes(c[rows], packer), buckets), None)

        for b in batches:
            ids = b.column(0).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()
            data, offs = kit.flat(b.column(1))
            th = text_hash(data, offs) if repeated else np.zeros(len(ids), np.int64)
            row, at, a, n, h, f = contexts_of(data, offs)
            c = np.zeros(len(row), CONTEXT)
            for name, v in (("h", h), ("f", f), ("doc", ids[row]), ("th", th[row]), ("at", at), ("a", a), ("n", n)):
                c[name] = v
            held.append(c)
            count += len(c)
            if count > HELD:
                yield from sent()
                held, count = [], 0
        if count:
            yield from sent()

    return docs.mapInArrow(kit.tidy(run), WIDE)


WIDE = "bucket long, doc long, th long, kind byte, payload binary"
_WIDE = pa.schema([("bucket", pa.int64()), *_MIXED])


def _wide(buckets: pa.RecordBatch | None, mixed: pa.RecordBatch | None) -> pa.RecordBatch:
    got = buckets if buckets is not None else mixed
    at = {n: got.column(k) for k, n in enumerate(got.schema.names)}
    return pa.RecordBatch.from_arrays([at.get(f.name, pa.nulls(got.num_rows, f.type)) for f in _WIDE], schema=_WIDE)


def text_hash(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each text, which tells texts of one id apart."""
    out = np.zeros(len(offs) - 1, U64)
    for i, j in kit.chunks(offs):
        h = kit.span_hash(kit.prefix_hash(data[offs[i] : offs[j]]), offs[i:j] - offs[i], offs[i + 1 : j + 1] - offs[i])
        out[i:j] = h
    return out.astype(np.int64)


def match(contexts: DataFrame) -> DataFrame:
    """Step 2 on contexts by bucket: marks and requests by document."""
    hot = HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        parts = [from_planes(x.as_py(), CONTEXT, opener) for b in batches for x in b.column(1)]
        if not parts:
            return
        c = np.concatenate(parts)
        del parts
        told = np.unique(c["h"][c["n"] == SPLIT])
        c, first = firsts(c[c["n"] != SPLIT])
        again = c[~first]
        if len(again):
            yield _marks(again["doc"], again["th"], again["at"], again["at"] + again["n"].astype(np.int64) + LENGTH)
        c = c[first]
        each = _sizes(c["h"])
        salts = np.where(np.isin(c["h"], told), SALTS, np.minimum(-(-each // hot), SALTS))
        asked = (each > 1) | (salts > 1)
        if asked.any():
            yield _asks(c[asked], salts[asked])

    return contexts.select("bucket", "payload").repartition("bucket").mapInArrow(kit.tidy(run), "doc long, th long, kind byte, payload binary")


def meet(rows: DataFrame, buckets: int, keep: bool, carried: str | None, last: bool) -> DataFrame:
    """Steps 3 and 5 on texts, marks and requests: results, and (unless last) open texts, their marks and asked contexts."""
    extra = ", c " + carried if carried else ""
    result = "bucket long, doc long, th long, kind byte, payload binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string" + extra
    c_type = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, opener = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        key, marks, asks, seen = None, [], [], b""
        spans: tuple[list, list] | None = None  # of key, joined, once its first text is there
        out: list[dict] = []
        ctx: list[tuple] = []
        size = 0

        def met(text: bytes, c) -> None:
            """One text of key, after all its marks and requests."""
            nonlocal size, spans, seen
            body = opener.decompress(text)
            new = spans is None
            if new:
                m = np.concatenate(marks) if marks else np.zeros(0, MARK)
                at, end = joined(m["at"].astype(np.int64), m["end"].astype(np.int64))
                spans, seen = (at.tolist(), end.tolist()), body
            elif body != seen:
                raise ValueError(f"two texts of id {key[0]} have the same 64-bit hash")
            if asks and not last:
                if new:
                    for x in np.concatenate(asks):
                        at, stop = int(x["at"]), int(x["at"]) + int(x["n"]) + LENGTH
                        ctx.append((int(x["h"]), int(x["salt"]), int(x["a"]), key[0], key[1], at, body[at:stop]))
                    if marks:
                        out.append({"doc": key[0], "th": key[1], "kind": MARKS, "payload": b"".join(m.tobytes() for m in marks)})
                out.append({"doc": key[0], "th": key[1], "kind": TEXT, "payload": text, "c": c})
                size += len(text)
                return
            left, before = [], 0
            for s, e in zip(*spans):
                left.append(body[before:s])
                before = e
            left.append(body[before:])
            kept = b"".join(left)
            out.append({"doc": key[0], "kind": -1, "n_bytes": len(body), "n_removed": len(body) - len(kept), "n_spans": len(spans[0]), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": as_text(body, spans) if keep else None, "c": c})
            size += len(kept) if keep else 100

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal out, ctx, size
            if ctx:
                h = np.array([x[0] for x in ctx], U64) + np.array([x[1] for x in ctx], U64) * U64(0x9E3779B97F4A7C15)
                b = _bucketed(h, lambda rows: packer.compress(pack_contexts([ctx[k] for k in rows])), buckets)
                out += [{"bucket": k, "payload": p} for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            schema = pa.schema([*_WIDE, ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), *([("c", c_type)] if carried else [])])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in schema], schema=schema)
            out, ctx, size = [], [], 0

        for b in batches:
            at = {n: k for k, n in enumerate(b.schema.names)}
            c_type = b.schema.field(at["c"]).type if carried else None
            cs = b.column(at["c"]).to_pylist() if carried else [None] * b.num_rows
            for doc, th, kind, payload, c in zip(*(b.column(at[n]).to_pylist() for n in ("doc", "th", "kind", "payload")), cs):
                if (doc, th) != key:
                    key, marks, asks, spans = (doc, th), [], [], None
                if kind == TEXT:
                    met(payload, c)
                    if size > 8 << 20 or len(out) > 20_000:
                        yield from sent()
                elif kind == MARKS:
                    marks.append(np.frombuffer(payload, MARK))
                else:
                    asks.append(np.frombuffer(payload, ASK))
        yield from sent()

    return rows.repartition("doc", "th").sortWithinPartitions("doc", "th", "kind").mapInArrow(kit.tidy(run), result)


_HEAD = np.dtype([("h", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("salt", "<u2"), ("at", "<u4"), ("a", "u1"), ("size", "u1")])


def as_text(body: bytes, spans: tuple[list, list]) -> str:
    """The remaining bytes as text; a character that a cut leaves in part stays whole, as its bytes were not all repeats."""
    out, before = [], 0
    for s, e in [*zip(*spans), (len(body), len(body))]:
        while s < len(body) and body[s] & 0xC0 == 0x80:
            s += 1
        out.append(body[before:s])
        while e < len(body) and body[e] & 0xC0 == 0x80:
            e -= 1
        before = max(s, e)
    return b"".join(out).decode("utf-8", "replace")


def pack_contexts(rows: list[tuple]) -> bytes:
    head = np.zeros(len(rows), _HEAD)
    for k, (h, salt, a, doc, th, at, text) in enumerate(rows):
        head[k] = h, doc, th, salt, at, a, len(text)
    return len(rows).to_bytes(4, "little") + head.tobytes() + b"".join(r[6] for r in rows)


def sort_blocks(contexts: DataFrame, buckets: int) -> DataFrame:
    """Step 4 on asked contexts by bucket: marks, and of split anchors the windows that stay first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        heads, texts = [], []
        for b in batches:
            for x in b.column(1):
                raw = opener.decompress(x.as_py())
                n = int.from_bytes(raw[:4], "little")
                heads.append(np.frombuffer(raw, _HEAD, n, 4))
                texts.append(np.frombuffer(raw, np.uint8, -1, 4 + n * _HEAD.itemsize))
        if not heads:
            return
        head, text = np.concatenate(heads), np.concatenate(texts)
        del heads, texts
        bounds = np.concatenate([[0], np.cumsum(head["size"], dtype=np.int64)])
        order = np.lexsort((head["at"], head["th"], head["doc"], head["salt"], head["h"]))
        head, begin = head[order], bounds[:-1][order]
        new = np.concatenate([[True], (head["h"][1:] != head["h"][:-1]) | (head["salt"][1:] != head["salt"][:-1])])
        group = np.append(np.flatnonzero(new), len(head))
        windows = np.concatenate([[0], np.cumsum(head["size"].astype(np.int64) - LENGTH + 1)])
        k = 0
        while k < len(group) - 1:  # one block of whole anchors at a time
            j = max(k + 1, int(np.searchsorted(windows[group], windows[group[k]] + BLOCK, "right")) - 1)
            lo, hi = group[k], group[j]
            k = j
            own, size = head[lo:hi], head["size"][lo:hi].astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(size)])
            line = text[np.repeat(begin[lo:hi] - offs[:-1], size) + np.arange(offs[-1])]
            of, start, cls = suffixes.classes(line, offs, own["a"].astype(np.int64), LENGTH)
            anchor = (np.cumsum(new[lo:hi]) - 1)[of]
            order = np.lexsort((start, of, anchor, cls))  # contexts of an anchor stand in document order
            of, start, cls, anchor = of[order], start[order], cls[order], anchor[order]
            first = np.concatenate([[True], (cls[1:] != cls[:-1]) | (anchor[1:] != anchor[:-1])])
            at = own["at"][of].astype(np.int64) + start
            if not first.all():
                m = ~first
                yield _wide(None, _marks(own["doc"][of[m]], own["th"][of[m]], at[m], at[m] + LENGTH))
            split = first & (own["salt"][of] > 0)
            if split.any():
                w = np.zeros(int(split.sum()), FIRST)
                s = offs[of[split]] + start[split]
                sums = kit.prefix_hash(line)
                w["x"] = kit.span_hash(sums, s, s + LENGTH)
                w["y"] = kit.span_hash(kit.prefix_hash(line ^ 0x5A), s, s + LENGTH)
                w["doc"], w["th"], w["at"] = own["doc"][of[split]], own["th"][of[split]], at[split]
                yield _wide(_bucketed(w["x"], lambda rows: w[rows].tobytes(), buckets), None)

    return contexts.repartition("bucket").mapInArrow(kit.tidy(run), WIDE)


def settle(windows: DataFrame) -> DataFrame:
    """The windows of split anchors, by their hash: marks of all but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x.as_buffer(), FIRST) for b in batches for x in b.column(1)]
        if not parts:
            return
        w = np.concatenate(parts)
        w = w[np.lexsort((w["at"], w["th"], w["doc"], w["y"], w["x"]))]
        m = np.concatenate([[False], (w["x"][1:] == w["x"][:-1]) & (w["y"][1:] == w["y"][:-1])])
        if m.any():
            yield _marks(w["doc"][m], w["th"][m], w["at"][m].astype(np.int64), w["at"][m].astype(np.int64) + LENGTH)

    return windows.select("bucket", "payload").repartition("bucket").mapInArrow(kit.tidy(run), "doc long, th long, kind byte, payload binary")


def packed(docs: DataFrame, carried: str | None, repeated: bool) -> DataFrame:
    """Texts as rows that meet marks: id, the text's hash where an id has several rows, compressed bytes, and the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data, offs = kit.flat(b.column(1))
            body = data.tobytes()
            zipped = pa.array([packer.compress(body[s:e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.binary())
            cols = [b.column(0).cast(pa.int64()).fill_null(-(1 << 63)), pa.array(text_hash(data, offs) if repeated else np.zeros(b.num_rows, np.int64)), pa.array(np.full(b.num_rows, TEXT, np.int8)), zipped]
            yield pa.RecordBatch.from_arrays([*cols, *([b.column(2)] if carried else [])], names=["doc", "th", "kind", "payload", *(["c"] if carried else [])])

    return docs.mapInArrow(kit.tidy(run), "doc long, th long, kind byte, payload binary" + (f", c {carried}" if carried else ""))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; kept (the remaining bytes as text, characters of which a byte remains whole) with keep_text; the columns of carry."""
    spark = docs.sparkSession
    buckets = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    three = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[F.col(c) for c in carry]).alias("c")) if carry else two
    carried = three.schema["c"].dataType.simpleString() if carry else None
    empty = [F.lit(None).cast(carried).alias("c")] if carry else []
    row = ["doc", "th", "kind", "payload"]

    def mixed(df: DataFrame) -> DataFrame:
        return df.select(*row, *empty)

    repeated = two.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    pieces = kit.staged(cut(two, buckets, repeated), "contexts")
    asked = match(pieces.where("bucket is not null"))
    met = kit.staged(meet(packed(three, carried, repeated).unionByName(mixed(pieces.where("bucket is null"))).unionByName(mixed(asked)), buckets, keep_text, carried, False), "met")
    kit.drop(spark, pieces._staged_at)
    found = kit.staged(sort_blocks(met.where("bucket is not null").select("bucket", "payload"), buckets), "sorted")
    opened = met.where("bucket is null and kind >= 0").select(*row, *(["c"] if carry else []))
    more = mixed(found.where("bucket is null")).unionByName(mixed(settle(found.where("bucket is not null"))))
    done = meet(opened.unionByName(more), buckets, keep_text, carried, True).where("kind = -1").unionByName(met.where("kind = -1"))
    doc_id = F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id")
    return done.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []), *[F.col("c").getField(c).alias(c) for c in carry or []])


def op1_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(kit.read_table(spark, sf_dir, "documents"))


#: The result as SQL: every string of 100 bytes in hexadecimal, all but the first of equal ones, and the bytes that these cover.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS k FROM d WHERE n >= 100)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS place FROM w) WHERE place > 1),
g AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, run, min(k) AS a, max(k) + 100 AS z FROM (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM g) GROUP BY 1, 2),
e AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS stops FROM s GROUP BY 1),
l AS (SELECT doc_id, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda i: substr(h, 2 * CASE WHEN i = 0 THEN 0 ELSE stops[i] END + 1, 2 * (CASE WHEN i = len(starts) THEN n ELSE starts[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE stops[i] END))), '') END AS left_h FROM d LEFT JOIN e USING (doc_id))
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(left_h)) AS kept_sha256 FROM l
"""
