"""Suffix order by two-stage sorting, for sets of short byte strings, in numpy."""

from __future__ import annotations

import numpy as np


def words_of(t: np.ndarray) -> np.ndarray:
    """The eight signs from each place on as one number, large numbers for large signs; zeros past the end."""
    k = np.concatenate([t, np.zeros(64, np.uint8)]).astype(np.uint64)
    for n in (1, 2, 4):
        k = (k[:-n] << np.uint64(8 * n)) | k[n:]
    return k


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """All places of ``t`` (uint8, last sign 0) in the order of their suffixes, exact to ``depth`` signs.

    Stage one sorts only the suffixes smaller than their successor, eight signs at a time, going on with what is
    still tied. Stage two induces all others in one scan over the buckets of first signs: in a bucket they come
    before the sorted ones, in the order of their successors, which lie in buckets already scanned or, in runs of
    one sign, one layer before.
    """
    n = len(t)
    k = words_of(t)
    after = np.concatenate([t[1:], [0]])
    # smaller than its successor: a rise, or a run of equal signs that ends in a rise
    change = np.flatnonzero(t != after)
    if not len(change) or change[-1] != n - 1:
        change = np.append(change, n - 1)
    run_end = change[np.searchsorted(change, np.arange(n))]
    small = t[run_end] < after[run_end]
    small[t == 0] = True  # separators are sorted too
    s = np.flatnonzero(small)
    s = s[np.argsort(k[s], kind="stable")]
    key = k[s]
    tied = np.concatenate([[False], key[1:] == key[:-1]])
    group = np.cumsum(~tied)
    for d in range(8, depth, 8):
        open_ = np.flatnonzero(tied | np.concatenate([tied[1:], [False]]))
        if not len(open_):
            break
        at = s[open_]
        key = k[np.minimum(at + d, n)]
        o = np.lexsort((key, group[open_]))
        s[open_] = at[o]
        key, g = key[o], group[open_]
        same = np.concatenate([[False], (g[1:] == g[:-1]) & (key[1:] == key[:-1])])
        tied[open_] = same
        group = np.cumsum(~tied)
    rank = np.zeros(n + 1, np.int64)
    order = np.empty(n, np.int64)
    rest = np.flatnonzero(~small)
    layer = run_end[rest] - rest
    by = np.lexsort((layer, t[rest]))
    rest, layer = rest[by], layer[by]
    sign_rest, sign_small = t[rest], t[s]
    filled = 0
    for c in np.unique(t).tolist():
        a, z = np.searchsorted(sign_rest, [c, c + 1])
        while a < z:  # one layer of the bucket: all successors are placed
            b = a + int(np.searchsorted(layer[a:z], layer[a], "right"))
            part = rest[a:b]
            part = part[np.argsort(rank[part + 1], kind="stable")]
            order[filled:filled + len(part)] = part
            rank[part] = np.arange(filled, filled + len(part))
            filled += len(part)
            a = b
        a, z = np.searchsorted(sign_small, [c, c + 1])
        order[filled:filled + z - a] = s[a:z]
        rank[s[a:z]] = np.arange(filled, filled + z - a)
        filled += z - a
    return order


def shared_prefix(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in ``order`` has its first ``length`` (at least 8) signs in common with the one before."""
    k = words_of(t)
    same = np.ones(len(order), bool)
    same[:1] = False
    for d in [*range(0, length - 8, 8), length - 8]:
        at = np.flatnonzero(same)
        same[at] = k[order[at] + d] == k[order[at - 1] + d]
    return same
