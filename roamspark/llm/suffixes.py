"""Suffix sorting within blocks by a difference cover; dedup.py runs it on Spark.

Texts of a block are laid out so that a place they share (their anchor) stands at a multiple of V. Sample places are those whose residue modulo V is in COVER, a
difference cover: any two places have an offset below V that takes both into the sample. Sample suffixes are ranked first, by their leading V bytes and
then by doubling (a place V, 2 V, ... further on has the same residue, so it is in the sample too). All suffixes are then sorted by V leading bytes, and
longer ties by the rank of the sample place at the offset that their residue shares; equal strings of a block have equal residues.
"""

from __future__ import annotations

import numpy as np

V = 16
#: The small steps below the root of V and its multiples: every residue is a difference of two of them.
COVER = np.array(sorted({*range(4), *range(0, V, 4)}))
TO_SAMPLE = np.array([min(d for d in range(V) if (r + d) % V in set(COVER.tolist())) for r in range(V)])
GAP = 256  # zero bytes after each text, more than any comparison reads


def _words(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that compares like them."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | line[at + k]
    return out


def _dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks from 1 by keys, the first the most significant; equal keys have equal ranks. And the order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        ranked = k[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    return rank, order


def cover_ranks(line: np.ndarray, used: np.ndarray, longest: int) -> np.ndarray:
    """Of every place of line its rank among sample suffixes (of longest bytes at least), 0 outside the sample and the texts."""
    residue = np.zeros(V, bool)
    residue[COVER] = True
    at = np.flatnonzero(used & np.resize(residue, len(line)))
    ranks = np.zeros(len(line), np.int64)
    if not len(at):
        return ranks
    ranks[at], _ = _dense(_words(line, at), _words(line, at + 8))
    span = V
    while span < longest:
        ranks[at], _ = _dense(ranks[at], ranks[at + span])
        span *= 2
    return ranks


def classes(texts: np.ndarray, bounds: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of a block in order: text number, start within it, and the number of its class of equal leading length bytes. Only starts with length bytes after them."""
    size = np.diff(bounds)
    room = -(-(size + GAP + V) // V) * V
    base = np.concatenate([[0], np.cumsum(room)])
    begin = base[:-1] + (-anchor) % V  # so that begin + anchor is a multiple of V
    line = np.zeros(base[-1] + GAP, np.uint8)
    used = np.zeros(len(line), bool)
    place = np.repeat(begin, size) + np.arange(len(texts)) - np.repeat(bounds[:-1], size)
    line[place] = texts
    used[place] = True
    n = np.maximum(size - length + 1, 0)
    text = np.repeat(np.arange(len(size)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = begin[text] + start
    ranks = cover_ranks(line, used, length)
    residue = at % V
    first, second = _words(line, at), _words(line, at + 8)
    order = np.lexsort((ranks[at + TO_SAMPLE[residue]], residue, second, first))
    at, text, start = at[order], text[order], start[order]
    same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1]) & (residue[order][1:] == residue[order][:-1])
    for k in range(V, length, 8):  # the common prefix of neighbours, as far as it is asked for
        left = np.flatnonzero(same)
        step = min(k, length - 8)
        same[left] = _words(line, at[left] + step) == _words(line, at[left + 1] + step)
    group = np.cumsum(np.concatenate([[0], ~same])) if len(at) else np.zeros(0, np.int64)
    return text, start, group
