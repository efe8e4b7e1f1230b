"""A small n-gram index in flat arrays, for tasks that generate whole sequences by themselves.

A step of generation needs the step before it, so over a distributed index every step is a join of all
sequences. An index whose size is known to be small is sent to the tasks instead, which then
take each sequence from its seed to its end. Draws are those of the joins: the same uniform numbers
by seed, sequence and step, the same order of tokens, the same back-off.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashed(ids: np.ndarray, seed: int) -> np.ndarray:
    """One hash for each row of token numbers."""
    with np.errstate(over="ignore"):
        out = np.full(len(ids), ids.shape[1] * 2 + 1 + (seed << 8), np.uint64) * _ODD
        for column in ids.T:
            out = (out ^ column.astype(np.uint64)) * _ODD
            out ^= out >> np.uint64(29)
    return out


class LocalIndex:
    """Counts by context: rows(n, ctx, tok, cnt), each context and token once."""

    def __init__(self, rows: pa.Table):
        n = rows["n"].to_numpy().astype(np.int64)
        tok, ctx = (x.combine_chunks() if isinstance(x := rows[c], pa.ChunkedArray) else x for c in ("tok", "ctx"))
        flat = ctx.flatten()
        self.kind = tok.type
        named = pc.unique(pa.concat_arrays([tok, flat.cast(tok.type)]))
        self.tokens = named.take(pc.sort_indices(named))  # numbers are in the order of tokens
        number = lambda x: pc.index_in(x, value_set=self.tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        tok, flat = number(tok), number(flat)
        begin = np.cumsum(n) - n
        self.seed = 0
        while True:
            key = np.zeros(len(n), np.uint64)
            for k in np.unique(n):
                some = np.flatnonzero(n == k)
                key[some] = _hashed(flat[begin[some][:, None] + np.arange(k)], self.seed)
            order = np.lexsort((tok, key))
            first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else order
            if self._whole(key[order], n[order], begin[order], flat, first):
                break
            self.seed += 1
        self.key = key[order][first]
        self.begin, self.size, self.flat = begin[order][first], n[order][first], flat
        self.edge = np.append(first, len(order))
        self.tok, self.cnt = tok[order], rows["cnt"].to_numpy()[order]
        self.longest = int(n.max()) if len(n) else -1
        self.known: dict[tuple, tuple[np.ndarray, list[float]]] = {}

    @staticmethod
    def _whole(key: np.ndarray, n: np.ndarray, begin: np.ndarray, flat: np.ndarray, first: np.ndarray) -> bool:
        """Do rows of one hash have one context?"""
        head = np.repeat(first, np.diff(np.append(first, len(key))))
        if (n != n[head]).any():
            return False
        return all((flat[begin[s][:, None] + np.arange(k)] == flat[begin[head[s]][:, None] + np.arange(k)]).all() for k in np.unique(n) for s in [np.flatnonzero(n == k)])

    def longest_suffix(self, ids: np.ndarray, most: int) -> np.ndarray:
        """For rows of token numbers, padded at the left with -1, the longest known suffix of at most `most` tokens; -1 if there is none."""
        found = np.full(len(ids), -1)
        for n in range(min(most, self.longest, ids.shape[1]), -1, -1):
            left = np.flatnonzero(found < 0)
            tail = ids[left, ids.shape[1] - n :]
            left, tail = left[(tail >= 0).all(axis=1)], tail[(tail >= 0).all(axis=1)]
            if not len(left):
                continue
            key = _hashed(tail, self.seed)
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            good = (self.key[at] == key) & (self.size[at] == n)
            left, tail, at = left[good], tail[good], at[good]
            good = (self.flat[self.begin[at][:, None] + np.arange(n)] == tail).all(axis=1)
            found[left[good]] = at[good]
        return found

    def distribution(self, at: int, t: float | None, k: int) -> tuple[np.ndarray, list[float]]:
        """Token numbers and cumulative probabilities after temperature (None: as they are) and top k, in the order of tokens."""
        if (got := self.known.get((at, t, k))) is None:
            tok, cnt = self.tok[self.edge[at] : self.edge[at + 1]], self.cnt[self.edge[at] : self.edge[at + 1]]
            prob = cnt / cnt.sum()
            if t is not None:
                prob = np.exp(np.log(prob + 1e-12) / t)
                prob /= prob.sum()
            kept = np.sort(np.lexsort((tok, -prob))[:k])
            tok, prob = tok[kept], prob[kept]
            if len(self.known) >= 1 << 16:
                self.known.clear()
            got = self.known[at, t, k] = tok, np.cumsum(prob / prob.sum()).tolist()
        return got


def uniform(*key) -> float:
    """As sampling.uniform."""
    return int(hashlib.md5(":".join(str(x) for x in key if x is not None).encode()).hexdigest()[:8], 16) / 4294967296.0


def generated(sent, steps: int, most: int, seed: int, heated: bool, fallback):
    """For mapInArrow over (prompt_id, ids, temperature, top_k): (prompt_id, ids) with `steps` tokens more. sent: a broadcast LocalIndex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            names, whole = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = [ids or [] for ids in whole]
            settings = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            width = min(most, max(index.longest, 0))
            tail = np.full((len(lists), width), -2)  # -2: nothing; -1: a token that no context has
            for row, ids in zip(tail, lists, strict=True):
                end = ids[len(ids) - width :] if len(ids) > width else ids
                if end and width:
                    row[width - len(end) :] = pc.fill_null(pc.index_in(pa.array(end, index.kind), value_set=index.tokens), -1).to_numpy(zero_copy_only=False)
            instead = -1 if fallback is None else pc.fill_null(pc.index_in(pa.scalar(fallback, index.kind), value_set=index.tokens), -1).as_py()
            more = np.full((len(lists), steps), -1)
            for step in range(steps):
                at = index.longest_suffix(tail, most)
                for i, (name, (t, k)) in enumerate(zip(names, settings, strict=True)):
                    if at[i] >= 0:
                        tok, cdf = index.distribution(int(at[i]), t if heated else None, k)
                        more[i, step] = tok[min(bisect_right(cdf, uniform(seed, name, step)), len(tok) - 1)]
                if width:
                    drawn = more[:, step : step + 1]
                    tail = np.concatenate([tail[:, 1:], np.where(drawn < 0, instead, drawn)], axis=1)
            drawn = index.tokens.take(pa.array(more.ravel(), mask=more.ravel() < 0)).to_pylist()
            drawn = [fallback if x is None else x for x in drawn]
            out = [None if ids is None else [*ids, *drawn[i * steps : (i + 1) * steps]] for i, ids in enumerate(whole)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(index.kind))], ["prompt_id", "ids"])

    return run
