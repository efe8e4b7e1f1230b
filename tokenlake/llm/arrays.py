"""Numpy primitives over Arrow text columns: words, lines, position-free hashes and sliding minima.

A text column arrives as one contiguous UTF-8 buffer with offsets, so every primitive works on
the bytes of many documents at once; nothing here builds a Python string per word.
A run's hash adds up terms in which symbol and place are mixed without being linear in either, and
a gram's hash joins its halves with a mixing step between, so no pattern of symbols cancels itself
out, as it would in a polynomial modulo 2**64. Hashes depend on content alone, never on process,
platform or position.

Whatever has an entry for each byte is made a segment at a time, so a text of any length costs its
own bytes, its words' entries and a bounded rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that one vectorised step holds; a longer single document is a step of its own.
STEP_BYTES = 1 << 17
#: Symbols of a long document that are expanded at a time.
SEGMENT = 1 << 19
#: Word separators: space and the control characters 9 to 13.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_table(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(BASE) + U64(seed))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        out = np.ones(size, U64)
        out[1] = U64(base & (2**64 - 1))
        k = 2
        while k < size:
            out[k : 2 * k] = out[:k] * U64(pow(base, k, 2**64))
            k *= 2
        have = _POWERS[base] = out
    return have[:n]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES = random_table(256, 17)


def texts(batch: pa.RecordBatch, name: str, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive row ranges of at most step bytes or one row; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) and column.nbytes > 2**30 else column
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + step, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """The words of several documents laid end to end.

    start, length: byte range of each word; doc: its document; first: index of each document's first
    word, with one entry more; hash: content hash of each word, from lower-cased bytes if asked; hashes
    with different seeds are independent.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, is_space: np.ndarray = IS_SPACE, seed: int = 0):
        start, length, hashes = [], [], []
        place = np.int32 if len(data) < 2**31 else np.int64
        for a, b in segments(data, is_space):
            part = data[a:b]
            inside = ~is_space[part]
            opens, closes = inside.copy(), inside.copy()
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            cuts = offsets[(offsets > a) & (offsets < b)] - a
            opens[cuts] |= inside[cuts]
            closes[cuts - 1] |= inside[cuts - 1]
            start.append((np.flatnonzero(opens) + a).astype(place))
            length.append((np.flatnonzero(closes) + a + 1 - start[-1]).astype(np.int32))
            chars = part[inside]
            hashes.append(hash_runs(LOWER[chars] if lower else chars, length[-1], seed))
        self.start = np.concatenate([np.zeros(0, place), *start])
        self.length = np.concatenate([np.zeros(0, np.int32), *length])
        self.hash = np.concatenate([np.zeros(0, U64), *hashes])
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(self.first))

    @property
    def end(self) -> np.ndarray:
        return self.start + self.length


def segments(data: np.ndarray, is_space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes that end before a separator."""
    a = 0
    while a < len(data):
        b = a + SEGMENT
        while b < len(data):
            found = np.flatnonzero(is_space[data[b : b + 4096]])
            if len(found):
                b += int(found[0])
                break
            b += 4096
        yield a, min(b, len(data))
        a = b


def hash_runs(chars: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """Content hash of each run of symbols; runs follow each other without gaps, none is empty."""
    out = np.zeros(len(length), U64)
    end = np.cumsum(length, dtype=np.int64)
    start = end - length
    offset = U64((seed + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))
    for lo in range(0, len(chars), SEGMENT):
        hi = min(lo + SEGMENT, len(chars))
        a, b = np.searchsorted(end, lo, "right"), np.searchsorted(start, hi)
        at = np.maximum(start[a:b] - lo, 0)
        size = np.minimum(end[a:b], hi) - lo - at
        x = np.arange(lo, hi, dtype=np.int64)
        x -= np.repeat(start[a:b], size)
        x = x.view(U64)
        x *= U64(BASE)
        x += offset
        x ^= BYTE_VALUES[chars[lo:hi]]
        x ^= x >> U64(32)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(29)
        out[a:b] += np.add.reduceat(x, at)
    return mix(out + length.astype(U64) * U64(0xA24BAED4963EE407))


def grams(values: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of values[i:i+n] for each i; n is reached by doubling, shorter results at the end are left out."""
    total = max(len(values) - n + 1, 0)
    if total <= 2 * SEGMENT:
        return _grams(values, n, seed) if total else np.zeros(0, U64)
    out = np.empty(total, U64)
    for k in range(0, total, SEGMENT):
        out[k : k + SEGMENT] = _grams(values[k : k + SEGMENT + n - 1], n, seed)
    return out


def _grams(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    return mix(runs(values, n) ^ U64(seed))


def runs(values: np.ndarray, n: int, stride: int = 1) -> np.ndarray:
    """values[i], values[i+stride], ..., n of them, joined for each i without a last mixing; n is reached by doubling."""
    total = len(values) - (n - 1) * stride

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * U64(BASE)
        x += b
        x ^= x >> U64(29)
        return x

    out, have, done, size, rest = None, values, 0, stride, n
    while rest:
        if rest & 1:
            part = have[done : done + total]
            out = part if out is None else join(out, part)
            done += size
        rest >>= 1
        if rest:
            have = join(have[:-size], have[size:])
            size *= 2
    return out


class Ranks:
    """How many of a mask's places before a given one are set, in one bit and one byte for each place."""

    def __init__(self, mask: np.ndarray):
        self.bits = np.append(np.packbits(mask), np.uint8(0))
        self.sums = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])

    def __call__(self, at: np.ndarray) -> np.ndarray:
        byte = at >> 3
        return self.sums[byte] + np.bitwise_count(self.bits[byte].astype(np.uint16) >> (8 - (at & 7)).astype(np.uint16))


class Spans:
    """Hashes of ranges of at least CONTEXT values, from prefix sums and the inverse of the base.

    What is summed are hashes of CONTEXT values each, so that two values alone cannot make the sums of different ranges equal.
    """

    CONTEXT = 4

    def __init__(self, values: np.ndarray, joined: np.ndarray | None = None):
        """joined: runs(values, CONTEXT), if they are known."""
        joined = runs(values, self.CONTEXT) if joined is None else joined
        n = len(joined)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(joined * powers(n), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(len(self.sums), pow(BASE, -1, 2**64))[start]
        return mix((self.sums[end - self.CONTEXT + 1] - self.sums[start]) * back + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """min(key[i:i+w]) for each i, by doubling."""
    if len(key) < w:
        return key[:0]
    out, span = key, 1
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(key) - w + 1], out[w - span :]) if w > span else out


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All integers of the ranges start[i] .. start[i]+length[i]-1, one after the other."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(start, np.int64) - (np.cumsum(length) - length), length)
    return np.arange(total) + shift


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Boolean mask of length n: inside at least one half-open range; ranges may reach beyond n."""
    if not len(start):
        return np.zeros(n, bool)
    if not (start[1:] >= start[:-1]).all():
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    end = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    edge = np.zeros(n + 1, np.int8)
    edge[np.minimum(start[new], n)] = 1
    edge[np.minimum(end[np.append(new[1:], True)], n)] = -1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def fields(column: pa.ListArray, i: int, *names: str) -> list[np.ndarray]:
    """The fields of row i of a list of structs, as arrays."""
    at = column.values.slice(column.offsets[i].as_py(), len(column[i]))
    return [at.field(at.type.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names]
