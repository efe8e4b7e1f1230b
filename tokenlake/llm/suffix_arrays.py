"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, binary search across arrays."""

from __future__ import annotations

import numpy as np

from tokenlake.llm.arrays import U64


def eights(text: np.ndarray, pad: int = 0) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; zeros follow the text."""
    out = np.zeros(len(text) + 8 + pad, U64)
    out[: len(text)] = text
    for k in (1, 2, 4):
        out[:-k] = (out[:-k] << U64(8 * k)) | out[k:]
    return out[: len(text) + pad]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: sort by eight bytes, then refine only the groups that are not yet single, doubling the depth."""
    n = len(text)
    key = eights(text)
    sa = np.argsort(key, kind="stable")
    ranked = key[sa]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    # a group's number is the place of its last member, so singles keep theirs for good
    number = np.repeat(np.append(starts[1:], n) - 1, np.diff(np.append(starts, n)))
    rank = np.empty(n, np.int64)
    rank[sa] = number
    depth = 8
    single = np.ones(n, bool)
    single[:-1] &= new[1:]
    single &= new
    todo = np.flatnonzero(~single)
    while len(todo):
        at = sa[todo]
        ahead = at + depth
        # suffixes that end within the depth are told apart by their length: the shorter is less
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + depth + 1, n - at)
        group = rank[at]
        order = np.argsort((group.astype(U64) << U64(32)) | follow.astype(U64), kind="stable")
        at, group, follow = at[order], group[order], follow[order]
        sa[todo] = at
        new = np.ones(len(todo), bool)
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(todo))
        rank[at] = np.repeat(todo[stops - 1], stops - starts)
        single = new.copy()
        single[:-1] &= new[1:]
        todo = todo[~single]
        depth *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """Kasai's lcp[k] of suffixes sa[k-1] and sa[k], 0 at k = 0.

    Taken in text order: the prefix at i is at least that at i - 1 less one, and exactly so where the
    bytes before both suffixes agree; only the other places are compared, eight bytes at a time.
    """
    n = len(text)
    key = eights(text, 8) if key is None else key
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    own = (before < 1) | (at == 0)
    own |= text[np.maximum(at - 1, 0)] != text[np.maximum(before - 1, 0)]
    i = np.flatnonzero(own)
    found = np.zeros(len(i), np.int64)
    live = np.flatnonzero(before[i] >= 0)
    while len(live):
        x, y = i[live] + found[live], before[i[live]] + found[live]
        inside = np.minimum(n - x, n - y)
        diff = key[np.minimum(x, n)] ^ key[np.minimum(y, n)]
        same = np.full(len(live), 8, np.int64)
        some = diff != 0
        # the leading equal bytes: the highest set bit tells the first that differs
        _, exponent = np.frexp((diff[some] >> U64(11)).astype(np.float64))
        low = (diff[some] >> U64(11)) == 0
        same[some] = np.where(low, 6 + (diff[some] < 256), (64 - (exponent + 11)) // 8)
        step = np.minimum(same, inside)
        found[live] += step
        live = live[(same == 8) & (inside > 8)]
    plcp = np.zeros(n, np.int64)
    plcp[i] = found
    last = np.maximum.accumulate(np.where(own, at, 0))
    plcp = np.maximum(plcp[last] - (at - last), 0)
    return plcp[sa]


def locate(needles: np.ndarray, length: int, hay: np.ndarray, sa: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of needles (big-endian words covering length bytes): the range of sa whose suffixes begin with it."""
    n, words = len(sa), needles.shape[1]
    tail = length - 8 * (words - 1)
    mask = U64(0xFFFFFFFFFFFFFFFF) << U64(8 * (8 - tail)) if tail < 8 else U64(0xFFFFFFFFFFFFFFFF)

    def less(which: np.ndarray, mid: np.ndarray, equal_too: bool) -> np.ndarray:
        """Is the suffix at sa[mid] less than (or, if equal_too, beginning with) the needle?"""
        out = np.full(len(which), equal_too)
        live = np.arange(len(which))
        for w in range(words):
            place = np.minimum(sa[mid[live]] + 8 * w, len(hay))
            a, b = key[place], needles[which[live], w]
            if w == words - 1:
                a, b = a & mask, b & mask
            differs = a != b
            out[live[differs]] = a[differs] < b[differs]
            live = live[~differs]
            if not len(live):
                break
        return out

    bounds = []
    for equal_too in (False, True):
        lo, hi = np.zeros(len(needles), np.int64), np.full(len(needles), n, np.int64)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            below = less(open_, mid, equal_too)
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        bounds.append(lo)
    return bounds[0], bounds[1]
