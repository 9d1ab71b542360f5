"""Suffix ranks of many strings by prefix doubling."""

from __future__ import annotations

import numpy as np


def suffix_ranks(ranks: np.ndarray, left: np.ndarray, depth: int, limit: int | None = None) -> np.ndarray:
    """Ranks of all suffixes of strings laid one after another, an end after each; equal suffixes have equal ranks.
    ``ranks``: those by the first ``depth`` symbols, 0 at a string's end; ``left``: symbols up to that end. With
    ``limit``, suffixes that agree in so many symbols may have equal ranks."""
    most = int(left.max(initial=0))
    most = most if limit is None else min(most, limit)
    distinct = 0
    while depth < most:
        later = np.zeros_like(ranks)
        inner = np.flatnonzero(left > depth)
        later[inner] = ranks[inner + depth]
        values, ranks = np.unique(ranks * (int(ranks.max()) + 1) + later, return_inverse=True)
        if len(values) == distinct:
            break
        distinct = len(values)
        depth *= 2
    return ranks
