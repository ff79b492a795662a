"""Suffix arrays by prefix doubling, for number sequences of one task."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order and each suffix's rank; a shorter suffix stands before its extensions.

    With ``depth`` only the first so many symbols are compared (a power of two); suffixes that
    agree in them have one rank, the place of the first of them.
    """
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    head = np.ones(n, bool)
    head[1:] = seq[order[1:]] != seq[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while not head.all() and (depth is None or step < depth):
        # Only rows in groups that are still tied are sorted again.
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, n))
        rows = np.flatnonzero(np.repeat(size > 1, size))
        suffix = order[rows]
        after = np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)] + 1, 0)
        group = rank[suffix]
        by = np.argsort(group * (n + 1) + after, kind="stable")
        suffix, after, group = suffix[by], after[by], group[by]
        order[rows] = suffix
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        head[rows] |= fresh
        rank[suffix] = np.maximum.accumulate(np.where(fresh, rows, 0))
        step *= 2
    return order, rank
