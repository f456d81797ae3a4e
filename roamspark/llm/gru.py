"""A bidirectional gated recurrent network with attention pooling over windows of words, in numpy; toxicity.py runs it on Spark.

A word's input is a learned vector of its hash bucket, the mean of learned vectors of its character n-gram buckets, and three numbers: the
log odds of the word, and the mean and the largest of its n-grams' log odds, as counted on the training documents.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from . import kit

U64 = np.uint64
WORD_BITS, GRAM_BITS = 15, 17
DIM, HIDDEN, ATT = 4, 8, 8
GRAMS, PREFIXES = (3, 5), (4, 5, 6, 7, 8, 9)
WINDOW, STRIDE = 128, 96
PER_DOC, FOLDS = 5, 4
#: Distinct words whose n-grams are worked out at a time.
BLOCK = 1 << 13


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, n-gram buckets of all words one after another, and the bounds of each word's n-grams. n-grams and prefixes are of bytes, with one space around the word."""
    words, grams, bounds = zip(*(_block_features(data, starts[i : i + BLOCK], ends[i : i + BLOCK]) for i in range(0, max(len(starts), 1), BLOCK)))
    before = np.cumsum([0, *map(len, grams)])
    return np.concatenate(words), np.concatenate(grams), np.concatenate([np.zeros(1, np.int64), *[b[1:] + k for b, k in zip(bounds, before)]])


def _block_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = ends - starts + 2
    offs = np.concatenate([[0], np.cumsum(size)])
    line = np.full(offs[-1], 32, np.uint8)
    at = np.arange(offs[-1]) - np.repeat(offs[:-1], size)
    inner = (at > 0) & (at < np.repeat(size - 1, size))
    line[inner] = data[np.repeat(starts - 1, size)[inner] + at[inner]]
    h = kit.prefix_hash(line)
    words = kit.span_hash(h, offs[:-1], offs[1:])
    spans, owner, salt = [], [], []
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        own = np.repeat(np.arange(len(size)), count)
        first = offs[:-1][own] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        spans.append((first, first + n))
        owner.append(own)
        salt.append(np.full(len(own), n, U64))
    for n in PREFIXES:
        own = np.flatnonzero(size >= n + 1)
        spans.append((offs[:-1][own], offs[:-1][own] + n))
        owner.append(own)
        salt.append(np.full(len(own), 16 + n, U64))
    first, last = (np.concatenate([s[k] for s in spans]) for k in (0, 1))
    owner_all = np.concatenate(owner)
    grams = kit.mix(kit.span_hash(h, first, last) + np.concatenate(salt) * U64(0x9E3779B97F4A7C15)) >> U64(64 - GRAM_BITS)
    order = np.argsort(owner_all, kind="stable")
    return (words >> U64(64 - WORD_BITS)).astype(np.int64), grams[order].astype(np.int32), np.searchsorted(owner_all[order], np.arange(len(size) + 1))


def windows(n_words: int) -> list[int]:
    """Starts of overlapping windows that cover all words."""
    return [0] if n_words <= WINDOW else [*range(0, n_words - WINDOW, STRIDE), n_words - WINDOW]


def _by_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        ranked = rows[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        out[ranked[first]] = np.add.reduceat(values[order], first, 0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        n_in = 2 * DIM + 3
        self.p = {
            "word": draw(1 << WORD_BITS, DIM, k=0.05), "gram": draw(1 << GRAM_BITS, DIM, k=0.05),
            "att": draw(2 * HIDDEN, ATT, k=0.3), "score": draw(ATT, k=0.3), "out": draw(2 * HIDDEN, k=0.3), "bias": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {"w" + d: draw(n_in, 3 * HIDDEN, k=n_in**-0.5), "u" + d: draw(HIDDEN, 3 * HIDDEN, k=HIDDEN**-0.5), "c" + d: np.zeros(3 * HIDDEN, np.float32)}
        self.word_odds, self.gram_odds = np.zeros(1 << WORD_BITS, np.float32), np.zeros(1 << GRAM_BITS, np.float32)
        self.square = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}
        self.pool = np.array([1.0, 0.0, 0.0])

    def inputs(self, words: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of each distinct word."""
        return np.concatenate([self._inputs(words[i : i + BLOCK], grams[bounds[i] : bounds[min(i + BLOCK, len(words))]], bounds[i : i + BLOCK + 1] - bounds[i]) for i in range(0, max(len(words), 1), BLOCK)])

    def _inputs(self, words: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = np.maximum(np.diff(bounds), 1)[:, None]
        has = np.diff(bounds) > 0
        mean, total, most = np.zeros((len(words), DIM), np.float32), np.zeros(len(words), np.float32), np.zeros(len(words), np.float32)
        if has.any():
            first, odds = bounds[:-1][has], self.gram_odds[grams]
            mean[has] = np.add.reduceat(self.p["gram"][grams], first, 0)
            total[has], most[has] = np.add.reduceat(odds, first), np.maximum.reduceat(odds, first)
        mean = mean / n
        return np.concatenate([self.p["word"][words], mean, self.word_odds[words][:, None], (total / n[:, 0])[:, None], most[:, None]], 1).astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions, so that a window only looks them up."""
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], 1)

    def run(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; ids index gates, mask is false where a window has no word."""
        n, t = ids.shape
        states, tape = [], []
        for k, d in enumerate("fb"):
            u, own = self.p["u" + d], gates[:, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1)]
            h, out, steps = np.zeros((n, HIDDEN), np.float32), np.empty((t, n, HIDDEN), np.float32), []
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                x, g = own[ids[:, i]], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                m = mask[:, i, None]
                after = np.where(m, new + z * (h - new), h)
                if keep:
                    steps.append((i, h, g, z, r, new, m))
                h = after
                out[i] = h
            states.append(out)
            tape.append(steps)
        s = np.concatenate(states, 2)
        hid = np.tanh(s @ self.p["att"])
        e = hid @ self.p["score"] + np.where(mask.T, 0, -1e9).astype(np.float32)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * s).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (s, hid, a, pooled, tape)) if keep else logit

    def step(self, words, grams, bounds, ids, mask, label, weight, rate: float) -> float:
        """One update by Adagrad; the mean loss."""
        x = self.inputs(words, grams, bounds)
        logit, (s, hid, a, pooled, tape) = self.run(self.projected(x), ids, mask, True)
        p = _sigmoid(logit)
        dl = ((p - label) * weight / weight.sum()).astype(np.float32)
        grad = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * self.p["out"]
        da = (s * dpool).sum(2)
        ds = a[:, :, None] * dpool
        de = a * (da - (a * da).sum(0))
        dhid = de[:, :, None] * self.p["score"] * (1 - hid**2)
        grad["score"] = (hid * de[:, :, None]).sum((0, 1))
        grad["att"] = np.tensordot(s, dhid, ((0, 1), (0, 1)))
        ds = ds + dhid @ self.p["att"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, dh = self.p["u" + d], np.zeros((len(ids), HIDDEN), np.float32)
            du = np.zeros_like(u)
            each = np.zeros((ids.shape[1], len(ids), 3 * HIDDEN), np.float32)
            for i, h, g, z, r, new, m in reversed(tape[k]):
                dh = dh + ds[i, :, HIDDEN * k : HIDDEN * (k + 1)]
                live = np.where(m, dh, 0)
                dnew = live * (1 - z) * (1 - new**2)
                dz = live * (h - new) * z * (1 - z)
                dr = dnew * g[:, 2 * HIDDEN :] * r * (1 - r)
                dg = np.concatenate([dz, dr, dnew * r], 1)
                du += h.T @ dg
                each[i] = np.concatenate([dz, dr, dnew], 1)
                dh = np.where(m, live * z, dh) + dg @ u.T
            dgates = _by_row(ids.T.ravel(), each.reshape(-1, 3 * HIDDEN), len(x))
            grad |= {"u" + d: du, "w" + d: x.T @ dgates, "c" + d: dgates.sum(0)}
            dx += (dgates @ self.p["w" + d].T).astype(np.float32)
        for k, g in grad.items():
            self.square[k] += g**2
            self.p[k] -= (rate * g / np.sqrt(self.square[k])).astype(np.float32)
        self._sparse("word", words, dx[:, :DIM], rate)
        n = np.diff(bounds)
        self._sparse("gram", grams, np.repeat(dx[:, DIM : 2 * DIM] / np.maximum(n, 1)[:, None], n, 0), rate)
        return float((weight * np.logaddexp(0, np.where(label > 0, -logit, logit))).sum() / weight.sum())

    def _sparse(self, name: str, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
        at, inverse = np.unique(rows, return_inverse=True)
        total = _by_row(inverse, g, len(at))
        self.square[name][at] += total**2
        self.p[name][at] -= (rate * total / np.sqrt(self.square[name][at])).astype(np.float32)

    def slim(self) -> Net:
        """Without what only training needs."""
        self.square = {}
        return self


class Words:
    """Distinct words of some documents: features and, of each document, its word rows."""

    def __init__(self, texts: list[bytes]):
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = kit.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        hs, ss, es, bs = [], [], [], [0]
        for i, j in kit.chunks(offs):
            s, e, b = kit.tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            hs.append(kit.span_hash(kit.prefix_hash(data[offs[i] : offs[j]]), s, e))
            ss.append(s + offs[i])
            es.append(e + offs[i])
            bs.extend((b[1:] + bs[-1]).tolist())
        h = np.concatenate(hs) if hs else np.zeros(0, U64)
        del hs
        _, first, self.rows = np.unique(h, return_index=True, return_inverse=True)
        self.bounds = np.array(bs)
        self.words, self.grams, self.gram_bounds = word_features(data, np.concatenate(ss)[first], np.concatenate(es)[first]) if len(h) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))

    def window(self, doc: int, start: int) -> np.ndarray:
        return self.rows[self.bounds[doc] + start : min(self.bounds[doc] + start + WINDOW, self.bounds[doc + 1])]


def _odds(buckets_of: Iterable[np.ndarray], label: np.ndarray, size: int) -> np.ndarray:
    """Log odds of a bucket's rate in toxic against clean documents, of which each counts it PER_DOC times at most."""
    seen = np.zeros((2, size))
    for b, y in zip(buckets_of, label):
        at, n = np.unique(b, return_counts=True)
        seen[int(y), at] += np.minimum(n, PER_DOC)
    total = seen.sum(1)
    share = total / max(total.sum(), 1)
    prior = 4 * share[:, None]  # as if seen four times more, dealt as all n-grams are
    return np.clip(np.log((seen[1] + prior[1]) / max(total[1], 1)) - np.log((seen[0] + prior[0]) / max(total[0], 1)), -5, 5).astype(np.float32)


def fit(texts: list[bytes], label: np.ndarray, share: float, epochs: int = 8, seed: int = 7) -> Net:
    """Trains on four fifths of the documents and calibrates on the rest; share: of toxic documents among all. Each document speaks through the window that
    the network, at first the word odds, scores highest, and clean ones through a random window too."""
    net, rng = Net(seed), np.random.default_rng(seed)
    label = np.asarray(label, np.float32)
    if len(set(label.tolist())) < 2:
        net.p["bias"][0] = 20.0 if len(label) and label[0] else -20.0
        net.p["out"][:] = 0
        return net.slim()
    w = Words(texts)
    kit.trim()
    train = np.arange(len(texts)) % 5 != 0
    docs = [w.rows[w.bounds[k] : w.bounds[k + 1]] for k in range(len(texts))]
    on = np.flatnonzero(train)
    net.word_odds = _odds((w.words[docs[k]] for k in on), label[on], 1 << WORD_BITS)

    def gram_of(rows: np.ndarray) -> np.ndarray:
        n = np.diff(w.gram_bounds)[rows]
        b = np.concatenate([[0], np.cumsum(n)])
        return w.grams[np.repeat(w.gram_bounds[rows], n) + np.arange(b[-1]) - np.repeat(b[:-1], n)]

    net.gram_odds = _odds((gram_of(docs[k]) for k in on), label[on], 1 << GRAM_BITS)
    starts = [windows(len(r)) for r in docs]
    own = net.inputs(w.words, w.grams, w.gram_bounds)[:, -3:]
    prior = own[:, 0] + own[:, 1] + 0.5 * own[:, 2]
    best = np.array([max(s, key=lambda a: prior[r[a : a + WINDOW]].sum()) if len(r) else 0 for r, s in zip(docs, starts)])
    whole = net.word_odds, net.gram_odds
    apart = []  # odds without a fold's own documents, so that its windows look as unseen ones do
    for f in range(FOLDS):
        rest = on[on % FOLDS != f]
        apart.append((_odds((w.words[docs[k]] for k in rest), label[rest], 1 << WORD_BITS), _odds((gram_of(docs[k]) for k in rest), label[rest], 1 << GRAM_BITS)) if len(set(label[rest].tolist())) > 1 else whole)
    for epoch in range(epochs):
        if epoch >= 3:
            best = best_windows(net, w, starts)[0]
        picks = [(k, best[k]) for k in on] + [(k, starts[k][rng.integers(len(starts[k]))]) for k in on if not label[k]]
        rng.shuffle(picks)
        folds = [[p for p in picks if p[0] % FOLDS == f] for f in range(FOLDS)]
        parts = [(f, own[i : i + 128]) for f, own in enumerate(folds) for i in range(0, len(own), 128)]
        for at in rng.permutation(len(parts)):
            f, part = parts[at]
            net.word_odds, net.gram_odds = apart[f]
            rows = [w.window(k, s) for k, s in part]
            used, ids = np.unique(np.concatenate([*rows, np.zeros(1, np.int64)]) if len(w.words) else np.zeros(1, np.int64), return_inverse=True)
            grid, mask = _grid(rows, ids)
            b = np.concatenate([[0], np.cumsum(np.diff(w.gram_bounds)[used])])
            g = gram_of(used)
            y = label[[k for k, _ in part]]
            net.step(w.words[used], g, b, grid, mask, y, np.where(y > 0, 1.5, 1.0).astype(np.float32), 0.1 if epoch < 5 else 0.04)
        net.word_odds, net.gram_odds = whole
    features = best_windows(net, w, starts)[1]
    held, y = features[~train], label[~train]
    weight = np.where(y > 0, share / max((y > 0).mean(), 1e-6), (1 - share) / max((y == 0).mean(), 1e-6))
    if 0 < y.mean() < 1:
        net.pool = _logistic(np.column_stack([held, np.ones(len(held))]), y, weight)
    del w, docs, starts, features
    kit.trim()
    return net.slim()


def pooled(logit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document, whose windows start at first, the highest logit and the log of one more than all windows' odds."""
    n = np.diff(np.append(first, len(logit)))
    doc = np.repeat(np.arange(len(first)), n)
    order = np.lexsort((-logit, doc))
    ranked = logit[order]
    return np.column_stack([ranked[first], np.log1p(np.add.reduceat(np.exp(np.minimum(logit, 8.0)), first))])


def _grid(rows: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows])
    mask = np.arange(max(size.max(), 1)) < size[:, None]
    grid = np.zeros(mask.shape, np.int64)
    grid[mask] = ids[: size.sum()]
    return grid, mask


def best_windows(net: Net, w: Words, starts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each document the start of its highest window, and what is pooled from all."""
    gates = net.projected(net.inputs(w.words, w.grams, w.gram_bounds)) if len(w.words) else np.zeros((1, 6 * HIDDEN), np.float32)
    doc = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    start = np.concatenate([np.asarray(s) for s in starts])
    logit = window_logits(net, gates, w.rows, w.bounds, doc, start)
    first = np.searchsorted(doc, np.arange(len(starts)))
    most = np.maximum.reduceat(logit, first)
    at = np.flatnonzero(logit == most[doc])
    return start[at[np.searchsorted(doc[at], np.arange(len(starts)))]], pooled(logit, first)


def window_logits(net: Net, gates: np.ndarray, rows: np.ndarray, bounds: np.ndarray, doc: np.ndarray, start: np.ndarray, block: int = 1024) -> np.ndarray:
    low = bounds[doc] + start
    size = np.minimum(bounds[doc + 1] - low, WINDOW)
    out = np.empty(len(doc))
    order = np.argsort(size, kind="stable")
    for i in range(0, len(order), block):
        k = order[i : i + block]
        t = max(int(size[k].max()), 1)
        mask = np.arange(t) < size[k][:, None]
        ids = np.zeros(mask.shape, np.int64)
        ids[mask] = rows[(low[k][:, None] + np.arange(t))[mask]]
        out[k] = net.run(gates, ids, mask)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of a weighted logistic fit, lightly held to 0, by damped Newton steps."""
    loss = lambda c: float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ c))).sum() + 0.05 * c @ c)
    c = np.zeros(x.shape[1])
    for _ in range(100):
        p = _sigmoid(x @ c)
        h = (x.T * (weight * p * (1 - p))) @ x + 0.1 * np.eye(len(c))
        d, rate = np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.1 * c), 1.0
        while rate > 1e-4 and loss(c - rate * d) > loss(c):
            rate /= 2
        c = c - rate * d
    return c
