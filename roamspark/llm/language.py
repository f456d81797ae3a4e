"""Language identification by interpolated Kneser-Ney character models.

Normalising lower-cases a text and takes its words: runs of ASCII letters and of bytes from 0x80. A model reads a word with one space before it
and one after, and predicts each character and the closing space from up to ORDER - 1 characters before it in the word. A text's cross-entropy in a
language is the sum over all its words, divided by the characters predicted; the least wins.

A model of a language is, for each order, a sorted array of 64-bit n-gram hashes with discounted probabilities, and one of context hashes with
back-off weights. Highest-order counts are raw, those below are continuation counts, with one absolute discount for each order.

Every language that a document is labelled with is learned. Fitting takes the DOCS_PER_LANG labelled documents of each language with the least hash of id and text, whole: one fifth
calibrates (at most CALIBRATED over all languages), the rest trains. Models stay in a staged table; documents are scored by BLOCK languages at a time, and what is kept of a block is the
best language, its bits and the sum that the score needs, so that neither the driver nor a task holds more models than those. Calibration fits the temperature of score = softmax(-bits / temperature), and the mean and spread of each language's own cross-entropy;
a text whose best cross-entropy exceeds that mean by more than REJECT spreads (wider for short texts) is rejected. Which documents have the least hashes is found from numbers of
documents by leading bits of the hash first, so that no task ranks a whole language.

Defined results: a null text or one without any letter is `und`, score 0, rejected; ties take the language that sorts first; repeated rows are scored alike;
documents with a null language are never fitted on, rows that repeat id, text and language once; without any labelled document all are `und`; an empty table gives no rows; texts of any
length are read whole; columns besides those named and those of keep are neither read nor returned, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kit

ORDER = 5
DOCS_PER_LANG = 500
#: Languages whose models are in memory at a time; documents that calibrate.
BLOCK, CALIBRATED = 64, 20_000
REJECT = 8.0
#: Least variance between documents of a language: the threshold is then 3 bits above its mean, which a text half in another learned language stays below.
LEAST_VAR = 0.15
#: Distinct words whose scores a worker holds between batches.
CACHE = 400_000
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SPACE = np.uint32(32)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes[k - 1] of the k-gram that ends at each predicted character, contexts' hashes likewise, the longest k there, and the word it belongs to."""
    text = " ".join(["", *words, ""]).encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(text, np.uint32).astype(np.uint64)
    space = c == _SPACE
    n = len(c)
    since = np.arange(n) - np.maximum.accumulate(np.where(np.concatenate([[True], space[:-1]]), np.arange(n) - 1, -1))  # characters from the space before
    grams, contexts = np.zeros((order, n), np.uint64), np.zeros((order, n), np.uint64)
    code = kit.mix(c + np.uint64(1))
    h = np.zeros(n, np.uint64)
    for k in range(order):  # h: of the k characters before; longer n-grams add one on the left
        contexts[k] = h + np.uint64(k + 1)
        grams[k] = kit.mix(contexts[k] * _MUL + code)
        left = np.concatenate([np.zeros(k + 1, np.uint64), code[: n - k - 1]]) if n > k + 1 else np.zeros(n, np.uint64)
        h = kit.mix(h * _MUL + left)
    word = np.cumsum(space) - 1
    at = np.arange(1, n)
    return grams[:, at], contexts[:, at], np.minimum(since[at] + 1, order), word[at - 1]


class Model:
    """An interpolated Kneser-Ney model in sorted hash arrays."""

    def __init__(self, grams: list[np.ndarray], prob: list[np.ndarray], contexts: list[np.ndarray], back: list[np.ndarray], floor: float):
        self.grams, self.prob, self.contexts, self.back, self.floor = grams, prob, contexts, back, floor

    @classmethod
    def fit(cls, words: list[str], counts: list[int], order: int = ORDER) -> Model:
        g, c, longest, of = _grams(words, order)
        weight = np.asarray(counts, np.int64)[of]
        grams, prob, contexts, back = [], [], [], []
        symbols = 1
        for k in range(order - 1, -1, -1):
            # raw counts where no longer n-gram ends here, and how many characters can stand before where one does
            whole = (longest == k + 1) if k < order - 1 else (longest >= k + 1)
            keys, ctx, n = g[k][whole], c[k][whole], weight[whole]
            if k < order - 1:
                _, one = np.unique(g[k + 1][longest > k + 1], return_index=True)
                keys = np.concatenate([keys, g[k][longest > k + 1][one]])
                ctx = np.concatenate([ctx, c[k][longest > k + 1][one]])
                n = np.concatenate([n, np.ones(len(one), np.int64)])
            key, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            count = np.bincount(inverse, n, len(key))
            cx, place = np.unique(ctx[first], return_inverse=True)
            total, kinds = np.bincount(place, count), np.bincount(place)
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 else 0.5
            grams.append(key)
            prob.append(((count - d) / total[place]).astype(np.float32))
            contexts.append(cx)
            back.append((d * kinds / total).astype(np.float32))
            symbols = max(symbols, len(key)) if k == 0 else symbols
        return cls(grams[::-1], prob[::-1], contexts[::-1], back[::-1], 1 / (symbols + 256))

    def bits(self, g: np.ndarray, c: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """Code length of each predicted character."""
        p = np.full(g.shape[1], self.floor)
        for k in range(len(self.grams)):
            use = longest > k
            ctx, seen = _find(self.contexts[k], c[k])
            at, there = _find(self.grams[k], g[k])
            p = np.where(use & seen, np.where(there, self.prob[k][at], 0) + self.back[k][ctx] * p, p)
        return -np.log2(p)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Scorer:
    """Bits and characters of documents under several models; scores of frequent words are held."""

    def __init__(self, models: list[Model], order: int = ORDER):
        self.models, self.order = models, order
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, len(models) + 1), np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """Of each word its bits under each model, and its predicted characters."""
        g, c, longest, of = _grams(words, self.order)
        out = np.zeros((len(words), len(self.models) + 1), np.float32)
        for k, m in enumerate(self.models):
            out[:, k] = np.bincount(of, m.bits(g, c, longest), len(words))
        out[:, -1] = np.bincount(of, minlength=len(words))
        return out

    def texts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Sums over each row's words; data is lower case."""
        starts, ends, bounds = kit.tokens(data, offs, NOT_LETTER)
        out = np.zeros((len(offs) - 1, len(self.models) + 1))
        if not len(starts):
            return out
        h = kit.span_hash(kit.prefix_hash(data), starts, ends)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at, known = _find(self.keys, keys)
        rows = np.zeros((len(keys), len(self.models) + 1), np.float32)
        rows[known] = self.rows[at[known]]
        if not known.all():
            body = data.tobytes()
            new = np.flatnonzero(~known)
            for part in np.array_split(new, -(-len(new) // 15_000)):
                rows[part] = self.words([body[starts[i] : ends[i]].decode("utf-8", "replace").replace(" ", "") for i in first[part]])
            if len(self.keys) + len(new) > CACHE:
                self.keys, self.rows = keys, rows
            else:
                order = np.argsort(both := np.concatenate([self.keys, keys[new]]))
                self.keys, self.rows = both[order], np.concatenate([self.rows, rows[new]])[order]
        for k in range(out.shape[1]):
            out[:, k] = kit.sums(rows[inverse, k].astype(np.float64), bounds)
        return out


def _lowered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return np.frombuffer(b"".join(parts), np.uint8), offs


def lettered(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:])))


class Identifier:
    """Models of all languages in a staged table, with what calibration found; spread: of each language mean, own variance, variance of a character's bits."""

    def __init__(self, langs: list[str], table: DataFrame | None, temperature: float = 1.0, spread: np.ndarray | None = None):
        self.langs, self.table, self.temperature, self.spread = langs, table, temperature, spread

    def blocks(self) -> Iterator[list[Model]]:
        """The models of BLOCK languages at a time, in order."""
        for i in range(0, len(self.langs), BLOCK):
            by: dict[str, list] = {lang: [] for lang in self.langs[i : i + BLOCK]}
            for r in self.table.where(F.col("lang").isin(list(by))).orderBy("lang", "k").toLocalIterator():
                by[r.lang].append(r)
            yield [Model(*([np.frombuffer(r[c], t) for r in rs] for c, t in (("grams", np.uint64), ("prob", np.float32), ("contexts", np.uint64), ("back", np.float32))), rs[0].floor) for rs in by.values()]


def state_of(sums: np.ndarray, start: int, temperature: float, before: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the best language so far (its number; the first of equals), its bits a character, and the sum of exp(z) over the languages, z = 0 for the best. before: of languages
    before start."""
    n = np.maximum(sums[:, -1:], 1)
    bits = sums[:, :-1] / n
    best = bits.argmin(1)
    own = bits[np.arange(len(bits)), best]
    scale = np.sqrt(n) / temperature
    total = np.exp(-(bits - own[:, None]) * scale).sum(1)
    if before is None:
        return best + start, own, total
    old, its, z = before
    least = np.minimum(own, its)
    total = total * np.exp(-(own - least) * scale[:, 0]) + z * np.exp(-(its - least) * scale[:, 0])
    return np.where(own < its, best + start, old), least, total


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = DOCS_PER_LANG) -> Identifier:
    """Fits on docs, which hold only rows that may be learned from. At most per_lang whole documents of a language are read."""
    text = F.col(text_col)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("h")).where("lang is not null and text is not null")
    ids = rows.select("lang", "h").distinct()  # hashes alone are ranked; texts are read only once chosen
    cell = F.shiftright("h", 52).alias("cell")
    sizes = ids.groupBy("lang", cell).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = sizes.withColumn("before", before).where(F.col("before") < per_lang).groupBy("lang").agg(F.max("cell").alias("most"))  # 4096 cells a language at most; one row a language is broadcast
    near = ids.join(F.broadcast(least), "lang").where(F.shiftright("h", 52) <= F.col("most")).select("lang", "h")
    ranked = kit.staged(near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= per_lang), "ranked")
    small = ranked.count() <= 1_000_000  # ids and ranks; beyond that a plain join
    chosen = rows.join(F.broadcast(ranked) if small else ranked, ["lang", "h"])
    sample = kit.staged(chosen.groupBy("lang", "h").agg(F.first("text").alias("text"), F.first("rank").alias("rank")), "languages")  # equal rows once

    def train(pdf):
        import pandas as pd

        counted: dict[str, int] = {}
        for start in range(0, len(pdf), 64):
            data, offs = _lowered(pdf["text"].iloc[start : start + 64].tolist())
            starts, ends, _ = kit.tokens(data, offs, NOT_LETTER)
            body = data.tobytes()
            for s, e in zip(starts, ends):
                w = body[s:e].decode("utf-8", "replace")
                counted[w] = counted.get(w, 0) + 1
        if not counted:
            return pd.DataFrame({"lang": [], "k": [], "grams": [], "prob": [], "contexts": [], "back": [], "floor": []})
        m = Model.fit(list(counted), list(counted.values()))
        return pd.DataFrame([(pdf["lang"].iloc[0], k, m.grams[k].tobytes(), m.prob[k].tobytes(), m.contexts[k].tobytes(), m.back[k].tobytes(), m.floor) for k in range(ORDER)], columns=["lang", "k", "grams", "prob", "contexts", "back", "floor"])

    models = sample.where("rank % 5 <> 0").groupBy("lang").applyInPandas(train, "lang string, k int, grams binary, prob binary, contexts binary, back binary, floor double")
    table = kit.staged(models, "models")
    langs = sorted(r.lang for r in table.where("k = 0").select("lang").collect())  # one short row a language
    each = max(1, CALIBRATED // max(len(langs), 1))
    who = calibrated(Identifier(langs, table), sample.where("rank % 5 = 0 and rank <= 5 * " + str(each)))
    kit.drop(docs.sparkSession, sample._staged_at, ranked._staged_at)
    return who


def calibrated(who: Identifier, held: DataFrame) -> Identifier:
    """Temperature and spreads from held documents (lang, text): one short row of sums for each reaches the driver."""
    if not who.langs:
        return who
    at = {lang: k for k, lang in enumerate(who.langs)}
    got = [r for r in _raw(held.select("lang", "text"), who).collect() if r.sums[-1] > 0 and r.lang in at]
    if not got:
        return who
    sums, truth = np.array([r.sums for r in got]), np.array([at[r.lang] for r in got])
    n = sums[:, -1:]
    bits = sums[:, :-1] / n

    def loss(t: float) -> float:
        z = -(bits - bits.min(1, keepdims=True)) * np.sqrt(n) / t
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).mean())

    who.temperature = float(min(np.geomspace(0.5, 32, 25), key=loss))
    spread = np.zeros((len(who.langs), 3))
    for k in range(len(who.langs)):
        own = bits[truth == k, k]
        own, size = (own, n[truth == k, 0]) if len(own) else (bits.min(1), n[:, 0])
        mean = np.average(own, weights=size)
        spread[k] = mean, max(np.average((own - mean) ** 2, weights=size), LEAST_VAR), max(np.median((own - mean) ** 2 * size), 4.0)
    who.spread = spread
    return who


def _sums(b: pa.RecordBatch, scorer: Scorer) -> Iterator[tuple[int, int, list, np.ndarray]]:
    """Row ranges of a batch whose second column is text, with the texts and their sums."""
    _, offs = kit.flat(b.column(1))
    for i, j in kit.chunks(offs, 4 * kit.CHUNK):
        texts = b.column(1).slice(i, j - i).to_pylist()
        yield i, j, texts, scorer.texts(*_lowered(texts))


def _raw(rows: DataFrame, who: Identifier) -> DataFrame:
    """lang of rows(lang, text) and sums: the bits of the text in each language, and its characters."""
    context = rows.sparkSession.sparkContext
    out = rows.withColumn("sums", F.array().cast("array<double>"))
    for models in who.blocks():
        shared = context.broadcast(models)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(shared.value)
            for b in batches:
                for i, j, _, sums in _sums(b, scorer):
                    old = b.column(2).slice(i, j - i).to_pylist()
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([[*o[:-1], *s] for o, s in zip(old, sums.tolist())], pa.list_(pa.float64()))], names=["lang", "text", "sums"])

        out = out.mapInArrow(kit.tidy(run), out.schema)
        out = kit.staged(out, "sums") if len(who.langs) > BLOCK else out
    return out.select("lang", "sums")


def _scored(rows: DataFrame, who: Identifier) -> DataFrame:
    """rows(id, text, ...) with the decision instead of the text; staged between blocks of languages."""
    context = rows.sparkSession.sparkContext
    key, kind = rows.columns[0], rows.schema[0].dataType.simpleString()
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:])
    out, n = rows.select(*rows.columns, F.lit(None).cast("long").alias("_best"), F.lit(None).cast("double").alias("_own"), F.lit(None).cast("double").alias("_z")), len(rows.columns)
    langs, temperature, spread = who.langs, who.temperature, who.spread
    starts = list(range(0, len(langs), BLOCK)) or [0]
    for start, models in zip(starts, who.blocks() if langs else [[]]):
        shared, last = context.broadcast(models), start == starts[-1]

        def run(batches: Iterator[pa.RecordBatch], shared=shared, start=start, last=last) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(shared.value)
            for b in batches:
                for i, j, texts, sums in _sums(b, scorer):
                    part = [c.slice(i, j - i) for c in b.columns]
                    before = tuple(c.to_numpy() for c in part[n:]) if start else None
                    state = state_of(sums, start, temperature, before) if langs else (np.zeros(j - i, np.int64), np.zeros(j - i), np.ones(j - i))
                    if last:
                        yield pa.RecordBatch.from_arrays([part[0], *_verdict(langs, spread, texts, sums[:, -1], *state), *part[2:n]], names=[key, "lang_pred", "score", "bits", "rejected", *b.schema.names[2:n]])
                    else:
                        yield pa.RecordBatch.from_arrays([*part[:n], *map(pa.array, state)], names=b.schema.names)

        if last:
            return out.mapInArrow(kit.tidy(run), f"`{key}` {kind}, lang_pred string, score double, bits double, rejected boolean{more}")
        out = kit.staged(out.mapInArrow(kit.tidy(run), out.schema), "block")
    raise AssertionError("no block")


def _verdict(langs: list[str], spread: np.ndarray | None, texts: list, n: np.ndarray, best: np.ndarray, own: np.ndarray, z: np.ndarray) -> list[pa.Array]:
    clear = np.array([lettered(t) for t in texts], bool) & (n > 0) & bool(langs)
    bad = np.zeros(len(texts), bool)
    if spread is not None:
        mean, var, each = spread[best].T
        bad = own > mean + REJECT * np.sqrt(var + each / np.maximum(n, 1))
    return [pa.array([langs[k] if ok else "und" for k, ok in zip(best, clear)], pa.string()), pa.array(np.where(clear, 1 / z, 0.0)), pa.array(np.where(clear, own, 0.0)), pa.array(bad | ~clear)]


def identify(docs: DataFrame, who: Identifier, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score, bits (a character, of the best language) and rejected of each document; keep: more columns to carry."""
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep or [])]
    out = _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept), who)
    return out.select("doc_id", "lang_pred", "score", "bits", "rejected", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep or [])])


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = kit.read_table(spark, sf_dir, "documents")
    who = fit(docs.where(kit.fold("doc_id", 4) != 2))
    return identify(docs, who).select("doc_id", (kit.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits", "rejected")
