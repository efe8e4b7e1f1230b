"""Content-defined blocks: which windows of a fixed length can possibly stand twice, without listing windows.

Every window of `window` symbols chooses an anchor: the least hash among its `gram`-symbol grams,
the leftmost of equals. Equal windows choose equal anchors at equal places, so two windows can
only be equal if their anchors' grams are. Neighbouring windows mostly choose the same anchor;
such a run of windows is a block, about one for each (window - gram) / 2 symbols. Blocks with equal
anchor hash and equal content hash hold exactly the same windows.

A window reaches at least (window - gram) / 2 symbols to one side of its anchor. With `sides`, the
hash of that many symbols on either side is given too, where the block has windows that reach so
far; two blocks can only share a window if their anchors and one of these sides are equal. So a
short frequent line makes an anchor frequent, but not the sides.
"""

from __future__ import annotations

import numpy as np

from tokenlake.llm.arrays import SEGMENT, U64, Spans, grams, mix, ranges, runs, sliding_min


def find(values: np.ndarray, first: np.ndarray, window: int, gram: int, sides: bool = False, table: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Blocks of documents values[first[i]:first[i+1]]; with a table, of table[values].

    doc: document; a: first window start within it; n: number of window starts; anchor: hash of the
    anchor's gram; body: hash of all symbols that the block's windows cover and the anchor's place;
    left, right: 32-bit hashes of the sides, 0 where no window reaches so far.

    A long document is taken in segments. What a segment finds last may go on behind it, so the next
    segment begins with that block's first window, and the blocks are those of the whole document.
    """
    if len(first) != 2 or len(values) <= 2 * SEGMENT:
        return _find(values if table is None else table[values], first, window, gram, sides)
    parts, at, n = [], int(first[0]), int(first[1])
    while True:
        stop = min(n, at + SEGMENT)
        part = values[at:stop]
        got = _find(part if table is None else table[part], np.array([0, stop - at]), window, gram, sides)
        got["a"] = got["a"] + (at - int(first[0]))
        if stop == n:
            parts.append(got)
            return {k: np.concatenate([p[k] for p in parts]) for k in got}
        at = int(got["a"][-1]) + int(first[0])
        parts.append({k: v[:-1] for k, v in got.items()})


def _find(values: np.ndarray, first: np.ndarray, window: int, gram: int, sides: bool) -> dict[str, np.ndarray]:
    count = np.maximum(np.diff(first) - window + 1, 0)
    s = ranges(first[:-1], count)
    if not len(s):
        none = np.zeros(0, np.int64)
        return dict.fromkeys(["doc", "a", "n", "anchor", "body", *(["left", "right"] if sides else [])], none)
    joined = runs(values, Spans.CONTEXT)
    gram_hash = mix(runs(joined, gram // Spans.CONTEXT, Spans.CONTEXT)) if gram % Spans.CONTEXT == 0 else grams(values, gram)
    bits = U64(max(20, len(values).bit_length()))
    key = ((gram_hash >> bits) << bits) | np.arange(len(gram_hash), dtype=U64)
    place = (sliding_min(key, window - gram + 1)[s] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = place[1:] != place[:-1]
    at = np.flatnonzero(new)
    a, n, place = s[at], np.diff(np.append(at, len(s))), place[at]
    doc = np.searchsorted(first, a, "right") - 1
    spans = Spans(values, joined)
    body = mix(spans.hash(a, a + n - 1 + window) ^ mix((place - a).astype(U64)))
    out = {"doc": doc, "a": a - first[doc], "n": n, "anchor": gram_hash[place].view(np.int64), "body": body.view(np.int64)}
    if sides:
        reach = (window - gram + 1) // 2
        most_left, most_right = place - a, window - gram - (place - a - n + 1)
        for name, far, start in (("left", most_left, place - reach), ("right", most_right, place + gram)):
            hashed, some = np.zeros(len(a), np.int64), far >= reach
            hashed[some] = (spans.hash(start[some], start[some] + reach) >> U64(33)).astype(np.int64) + 1
            out[name] = np.minimum(hashed, 2**31 - 1)
    return out
