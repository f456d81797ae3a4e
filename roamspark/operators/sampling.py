"""Diverse, random and balanced samples of a group's lines. Groups are bounded samples already, so numpy holds one at a time."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Above so many distinct lines a diverse sample is a random one.
DIVERSE_MOST = 2000


def tfidf(lines: list[str]) -> np.ndarray:
    """Unit vectors over word tokens of two or more word characters; idf = ln((1 + n) / (1 + df)) + 1. ValueError without any token."""
    bags = [re.findall(r"(?u)\b\w\w+\b", x.lower()) for x in lines]
    words = sorted({w for b in bags for w in b})
    if not words:
        raise ValueError("no words")
    at = {w: k for k, w in enumerate(words)}
    m = np.zeros((len(lines), len(words)))
    for row, bag in zip(m, bags):
        for w in bag:
            row[at[w]] += 1
    m *= np.log((1 + len(lines)) / (1 + (m > 0).sum(0))) + 1
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def cosine(m: np.ndarray) -> np.ndarray:
    return m @ m.T


def diverse(similarity: np.ndarray, k: int) -> list[int]:
    """Greedily the item that raises det / (1 + det) of the chosen ones' similarity most, the first of equals; in rising order."""
    chosen: list[int] = []
    while len(chosen) < min(k, len(similarity)):
        best, most = -1, -np.inf
        for i in range(len(similarity)):
            if i in chosen:
                continue
            d = np.linalg.det(similarity[np.ix_([*chosen, i], [*chosen, i])])
            if d / (1 + d) > most:
                best, most = i, d / (1 + d)
        if best < 0:
            break
        chosen.append(best)
    return sorted(chosen)


def random_of(lines: list[str], k: int, seed: int = 0) -> list[str]:
    """By a seeded hash of the text, so that it is the same wherever it runs."""
    import hashlib

    return sorted(lines, key=lambda x: hashlib.sha1(f"{seed}\0{x}".encode()).digest())[:k]


def kmeans_batches(vectors: np.ndarray, size: int, seed: int = 0, rounds: int = 20) -> list[list[int]]:
    """Balanced batches of at most size: Lloyd's centres, then each item to its nearest centre with room, nearest items first."""
    n = len(vectors)
    k = max(1, -(-n // size))
    centres = vectors[np.random.default_rng(seed).permutation(n)[:k]].copy()
    for _ in range(rounds):
        own = cosine_to(vectors, centres).argmax(1)
        new = np.array([vectors[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    score = cosine_to(vectors, centres)
    batches: list[list[int]] = [[] for _ in range(k)]
    for i in np.argsort(-score.max(1), kind="stable"):
        for c in np.argsort(-score[i], kind="stable"):
            if len(batches[c]) < size:
                batches[c].append(int(i))
                break
    return [sorted(b) for b in batches if b]


def cosine_to(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine moved to 0..1."""
    size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
    return 0.5 + 0.5 * (a @ b.T) / np.where(size == 0, 1, size)


def sample(lines: list[str], k: int, mode: str = "diverse", seed: int = 0) -> list[str]:
    """All distinct lines if they are k or fewer, else by mode: diverse, random or similar (the first balanced batch)."""
    lines = list(dict.fromkeys(lines))
    if len(lines) <= k:
        return lines
    if mode == "random" or mode == "diverse" and len(lines) > DIVERSE_MOST:
        return random_of(lines, k, seed)
    vectors = tfidf(lines)
    if mode == "diverse":
        return [lines[i] for i in diverse(cosine(vectors), k)]
    if mode == "similar":
        return [lines[i] for i in kmeans_batches(vectors, k, seed)[0]]
    raise ValueError(f"unknown mode {mode}")


def sampled_groups(samples: DataFrame, k: int, mode: str = "diverse") -> DataFrame:
    """skeleton, line of each group's sample; samples(skeleton, line_index, content) hold at most a few hundred lines a group."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_index")
        try:
            chosen = sample(pdf["content"].tolist(), k, mode)
        except ValueError:
            chosen = pdf["content"].drop_duplicates().tolist()[:k]
        return pd.DataFrame({"skeleton": pdf["skeleton"].iloc[0], "place": range(len(chosen)), "line": chosen})

    return samples.select("skeleton", "line_index", "content").groupBy("skeleton").applyInPandas(run, "skeleton string, place long, line string")


def repair_sample(lines: list[str], failing: str | None, k: int = 5) -> list[str]:
    """At most k lines, the failing one first."""
    rest = [x for x in dict.fromkeys(lines) if x != failing]
    return ([failing] if failing else []) + rest[: k - bool(failing)]


def batches(samples: DataFrame, size: int) -> DataFrame:
    """skeleton, batch, line_index: balanced batches of each group's distinct lines."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_index").drop_duplicates("content")
        try:
            vectors = tfidf(pdf["content"].tolist())
        except ValueError:
            vectors = np.ones((len(pdf), 1))
        rows = [(pdf["skeleton"].iloc[0], b, int(pdf["line_index"].iloc[i])) for b, part in enumerate(kmeans_batches(vectors, size)) for i in part]
        return pd.DataFrame(rows, columns=["skeleton", "batch", "line_index"])

    return samples.select("skeleton", "line_index", F.col("content")).groupBy("skeleton").applyInPandas(run, "skeleton string, batch long, line_index long")
