"""Repetition-coverage quality rules: rolling hashes of several n-gram lengths, in numpy.

One pass without a shuffle. For every document the words of 5- to 10-word windows and whole lines
are hashed by content; what counts is how many characters lie inside windows or lines that stand
in the text a second time. Hashes are compared within one document only (64 bits, mixed with the
document's place), so a document's figures never depend on its neighbours. Keys of a long text are sorted a
share of their values at a time.

Defined results: a null or empty text has zero words and fails the word-count rule; null ids pass
through; repeated rows and extra columns are judged row by row; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.arrays import SEGMENT, U64, Ranks, Words, grams, hash_runs, mix, ranges, texts
from tokenlake.llm.store import text_batches

#: Most of a text's word characters inside later copies of n-word windows, by n.
DUP_NGRAM_CHARS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most of a text's characters inside later copies of lines.
DUP_LINE_CHARS = 0.20
MIN_WORDS, REPEAT_PERCENT = 10, 20
SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_ngram_chars double, dup_line_chars double, base_failed boolean, kept boolean"
)

_SALT = U64(0xC2B2AE3D27D4EB4F)


def _first_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the first of its equals, stands at least twice) for each key; many keys are sorted a share of their values at a time."""
    first, several = np.empty(len(key), bool), np.empty(len(key), bool)
    shares = min(256, 1 << max(0, (len(key) // (2 * SEGMENT)).bit_length()))
    share = key.view(np.uint8)[:: key.itemsize] & np.uint8(shares - 1) if shares > 1 else None
    for k in range(shares):
        own = np.flatnonzero(share == k) if shares > 1 else None
        part = key if own is None else key[own]
        order = np.argsort(part, kind="stable")
        ranked = part[order]
        new = np.ones(len(part), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        twice = ~new
        twice[:-1] |= ~new[1:]
        at = order if own is None else own[order]
        first[at], several[at] = new, twice
    return first, several


def spread(mark: np.ndarray, n: int) -> np.ndarray:
    """Is one of the n places up to each marked?"""
    out, span = mark, 1
    while span < n:
        step = min(span, n - span)
        wider = out.copy()
        wider[step:] |= out[:-step]
        out, span = wider, span + step
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The figures of each document of one byte buffer."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    points = Ranks((data & 0xC0) != 0x80)
    size = np.empty(len(words.start), np.int32)
    for k in range(0, len(size), SEGMENT):
        start = words.start[k : k + SEGMENT]
        size[k : k + SEGMENT] = points(start + words.length[k : k + SEGMENT]) - points(start)
    per_doc = lambda at, weight=None: np.bincount(at, weight, n)[:n]

    def in_words(mask: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """How many words of each document are marked, or what they weigh."""
        if n == 1:
            return np.array([np.count_nonzero(mask) if weight is None else weight[mask].sum(dtype=np.int64)])
        return per_doc(words.doc[mask], None if weight is None else weight[mask])

    word_chars = in_words(np.ones(len(size), bool), size)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    marks = Ranks(symbol[data])(offsets)
    out = {"n_words": np.diff(words.first), "word_chars": word_chars, "n_symbols": np.diff(marks)}

    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], breaks[breaks + 1 < len(data)] + 1]))
    stop = np.append(begin[1:], len(data))
    stop = stop - (data[stop - 1] == 10) if len(begin) else stop[:0]
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    full = stop > begin
    begin, stop, line_doc = begin[full], stop[full], line_doc[full]
    line_hash = hash_runs(data[data != 10], stop - begin, seed=5)
    wordy = np.searchsorted(words.start, stop) > np.searchsorted(words.end, begin, "right")
    begin, stop, line_doc, line_hash = begin[wordy], stop[wordy], line_doc[wordy], line_hash[wordy]
    later = ~_first_of(mix(line_hash + line_doc.astype(U64) * _SALT))[0]
    out["n_dup_lines"] = per_doc(line_doc[later])
    ends = points(offsets)
    chars = np.maximum(np.diff(ends), 1)
    out["dup_line_chars"] = per_doc(line_doc[later], (points(stop) - points(begin))[later]) / chars

    alive = np.ones(len(words.hash), bool)
    failed = out["dup_line_chars"] > DUP_LINE_CHARS
    worst = np.zeros(n)
    for k, most in DUP_NGRAM_CHARS.items():
        key = grams(words.hash, k)
        at = ranges(words.first[:-1], np.maximum(np.diff(words.first) - k + 1, 0)) if n > 1 else np.arange(len(key), dtype=words.start.dtype)
        at = at[alive[at]]
        key = mix(key[at] + words.doc[at].astype(U64) * _SALT) if n > 1 else key[at] if len(at) < len(key) else key
        first, twice = _first_of(key)
        del key
        # only a window that stands twice can begin a longer one that does
        alive, later = np.zeros(len(words.hash), bool), np.zeros(len(words.hash), bool)
        alive[at[twice]], later[at[~first]] = True, True
        if k == 5:
            out["n_repeat_words"] = in_words(spread(alive, k))
        share = in_words(spread(later, k), size) / np.maximum(word_chars, 1)
        failed |= share > most
        worst = np.maximum(worst, share)
    out["dup_ngram_chars"] = worst
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~(out["base_failed"] | failed)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in texts(batch, "text"):
            got = measure(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), *(pa.array(got[k].astype(t.to_pandas_dtype())) for k, t in zip(names[1:], types[1:], strict=True))], names
            )


def repetition_quality(docs: DataFrame) -> DataFrame:
    """Figures and verdict of each row of docs(doc_id, text); columns of SCHEMA."""
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_rows, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs whose verdict is kept, with all their columns; no shuffle, as each row carries its own verdict."""
    text_batches(docs.sparkSession)
    schema = docs.schema

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = [measure(data, offsets)["kept"] for _, _, data, offsets in texts(batch, "text")]
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(passing, schema)
