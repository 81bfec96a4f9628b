"""Suffix arrays of word numbers by prefix doubling, and the intervals of suffixes that share their first words.

A sequence holds several texts; 0 ends each, and a suffix counts up to its 0, so nothing runs on into the next text.
"""

from __future__ import annotations

import numpy as np


def to_stop(ids: np.ndarray) -> np.ndarray:
    """How many words each place has up to the 0 that ends its text (0 at the 0 itself)."""
    n = len(ids)
    stops = np.flatnonzero(ids == 0)
    return stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)


def suffix_array(ids: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places in the order of their first `depth` words (None: all up to the text's end), equal ones by place.

    Ranks by the first k words give ranks by 2 k words: a pair of ranks, that of the place and that of the place k on, is sorted.
    ids end with 0.
    """
    n, left = len(ids), to_stop(ids)
    want = int(left.max()) + 1 if depth is None else depth
    rank, k = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < want:
        step = min(k, want - k)
        on = np.zeros(n, np.int64)
        # Rank 0 stands for a suffix that has ended; `step` on, ranks by k words overlap and still tell the order.
        inside = np.flatnonzero(left >= step)
        on[inside] = rank[inside + step] + 1
        both = rank * np.int64(n + 2 + int(rank.max())) + on
        order = np.argsort(both, kind="stable")
        sorted_ = both[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]))
        rank, k = new, k + step
    return order


def shared_words(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in the order, how many of its first `depth` words it shares with the one before (the LCP, cut at depth)."""
    n = len(ids)
    shared, same = np.zeros(n, np.int64), np.ones(n, bool)
    same[:1] = False
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    for k in range(depth):
        words = padded[order + k]
        same[1:] &= (words[1:] == words[:-1]) & (words[1:] != 0)
        shared += same
    return shared


def intervals(ids: np.ndarray, order: np.ndarray, shared: np.ndarray, k: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, how many): the intervals of the order whose suffixes share their first k words, those that have k words."""
    starts = np.flatnonzero(shared < k)
    sizes = np.diff(np.append(starts, len(order)))
    whole = left[order[starts]] >= k
    return order[starts[whole]], sizes[whole]
