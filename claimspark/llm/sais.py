"""Suffix arrays by induced sorting, and permuted common prefixes, over arrays of small whole numbers.

The textbook steps, on NumPy arrays: classify suffixes as S (smaller than the next) or L, sort the leftmost-S substrings
by inducing, name them, recurse on the names where they repeat, and induce the whole array from the sorted leftmost-S
suffixes. An inducing scan takes as many entries at once as don't yet feed each other, so it stays linear.
"""

from __future__ import annotations

import numpy as np

LEAST_STEP, MOST_STEP = 64, 1 << 16


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    ends = np.append(change, n - 1)  # last index of each run of equal symbols
    smaller = np.append(t[change] < t[change + 1], True)
    return np.repeat(smaller, np.diff(np.concatenate([[-1], ends])))


def _scan(t: np.ndarray, sa: np.ndarray, wanted: np.ndarray, at: np.ndarray, forward: bool) -> None:
    """From each entry in turn, put the suffix before it, if ``wanted``, at its bucket's next free place."""
    n, i, step = len(t), 0, 256
    view = sa if forward else sa[::-1]
    while i < n:
        end = min(i + step, n)
        source = view[i:end]
        p = source - 1
        take = np.flatnonzero((source > 0) & wanted[p])
        if len(take):
            p = p[take]
            c = t[p]
            order = np.argsort(c, kind="stable")
            cs = c[order]
            first = np.flatnonzero(np.concatenate([[True], cs[1:] != cs[:-1]]))
            rank = np.arange(len(cs)) - np.repeat(first, np.diff(np.append(first, len(cs))))
            to = np.empty(len(cs), np.int64)
            to[order] = at[cs] + rank if forward else n - 1 - (at[cs] - rank)
            nearest = int(to.min())
            if nearest < end:  # later entries of this step aren't known yet
                end = max(nearest, i + 1)
                keep = np.searchsorted(take, end - i)
                p, c, to = p[:keep], c[:keep], to[:keep]
                step = max(LEAST_STEP, step // 2)
            else:
                step = min(MOST_STEP, step * 2)
            view[to] = p
            at[c] = to + 1 if forward else n - 2 - to  # of equal symbols, the last stays
        else:
            step = min(MOST_STEP, step * 2)
        i = end


def _induce(t: np.ndarray, seeds: np.ndarray, s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sa = np.full(len(t), -1, np.int64)
    c = t[seeds]
    order = np.argsort(c, kind="stable")
    cs = c[order]
    last = np.flatnonzero(np.concatenate([cs[1:] != cs[:-1], [True]]))
    sa[ends[cs] - (np.repeat(last, np.diff(np.concatenate([[-1], last]))) - np.arange(len(cs)))] = seeds[order]
    _scan(t, sa, ~s, starts.copy(), True)
    filled = np.flatnonzero(sa >= 0)
    sa[filled[s[sa[filled]]]] = -1
    _scan(t, sa, s, ends.copy(), False)
    sa[0] = len(t) - 1
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of t, whole numbers from 0; its last must be 0 and occur nowhere else."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].astype(np.int64)
    t = t.astype(np.int64, copy=False)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    counts = np.bincount(t)
    ends = np.cumsum(counts) - 1
    starts = ends - counts + 1
    sa = _induce(t, lms, s, starts, ends)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = sa[is_lms[sa]]
    following = np.empty(n, np.int64)
    following[lms] = np.append(lms[1:], n - 1)
    size = following[ranked] - ranked
    same = size[1:] == size[:-1]
    active = np.flatnonzero(same)
    d = 0
    while len(active):
        a, b = ranked[active], ranked[active + 1]
        equal = t[a + d] == t[b + d]
        same[active[~equal]] = False
        active = active[equal & (d < size[active])]
        d += 1
    name = np.zeros(n, np.int64)
    name[ranked] = np.concatenate([[0], np.cumsum(~same)])
    if not same.all() and name[ranked[-1]] + 1 == len(lms):
        return _induce(t, ranked, s, starts, ends)
    return _induce(t, lms[suffix_array(name[lms])], s, starts, ends)


def _extend(t: np.ndarray, i: np.ndarray, j: np.ndarray, length: np.ndarray, cap: int) -> np.ndarray:
    length = length.copy()
    n = len(t)
    active = np.flatnonzero((length < cap) & (j >= 0))
    while len(active):
        a, b = i[active] + length[active], j[active] + length[active]
        inside = np.maximum(a, b) < n
        active, a, b = active[inside], a[inside], b[inside]
        active = active[t[a] == t[b]]
        length[active] += 1
        active = active[length[active] < cap]
    return length


def common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int = 1 << 30, grid: int = 8) -> np.ndarray:
    """In text order, how long a prefix each suffix shares with the one before it in the array, up to ``cap``.

    From one position to the next this falls by one at most, so every ``grid``-th is compared in full and the others go
    on from what that leaves.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa] = np.concatenate([[-1], sa[:-1]])
    out = np.zeros(n, np.int64)
    for k in range(min(grid, n)):
        at = np.arange(k, n, grid)
        least = np.zeros(len(at), np.int64) if k == 0 else np.maximum(out[at - 1] - 1, 0)
        least[before[at] < 0] = 0
        out[at] = _extend(t, at, before[at], least, cap)
    return out


def repeated(t: np.ndarray, length: int) -> np.ndarray:
    """True at each position whose next ``length`` symbols start at another position too."""
    sa = suffix_array(t)
    long = common_prefixes(t, sa, cap=length) >= length
    out = long.copy()
    out[sa[:-1][long[sa[1:]]]] = True
    return out


def repeated_later(t: np.ndarray, length: int, rank: np.ndarray) -> np.ndarray:
    """True at each position whose next ``length`` symbols start at a position of lower rank too."""
    sa = suffix_array(t)
    long = common_prefixes(t, sa, cap=length) >= length
    first = np.flatnonzero(~long[sa])  # where a class of suffixes that share so much begins in the array
    ranks = rank[sa]
    least = np.repeat(np.minimum.reduceat(ranks, first), np.diff(np.append(first, len(sa))))
    out = np.zeros(len(t), bool)
    out[sa] = ranks > least
    return out
