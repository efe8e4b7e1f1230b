"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised: lower case, every run of other than letters and digits
one space, in UTF-8. An item of m bytes that stands in a text with at most k edits shares at least
m - q + 1 - k q of its q-grams with it, all within a band of k + 1 diagonals. Bands overlap by k
diagonals, so one of them holds all of these; bands with fewer shared q-grams are dropped, the
others verified by alignment within the band, free at both ends in the text.

Text q-grams are tested against a bitmap, then looked up in a sorted array of the items' q-grams.
The benchmark is dealt into blocks of about `block_bytes`, each against all texts; a block is
collected, run, written and freed before the next, so neither table is assumed small. k is `percent`
of m, and less where the lemma would leave no q-gram to count. Long texts are looked through in
overlapping pieces that hold any place of an item whole.

Items under `least` bytes leave the lemma too few q-grams: they are looked for verbatim, by a hash
of their length at each byte of a text, and count where they begin and end at word boundaries.
Scripts written without spaces between words have a boundary beside each of their characters.

Defined results: null texts and items, and those empty after normalisation, match nothing; items
under `least` bytes after normalisation match verbatim only; repeated rows are matched once each; null ids are carried;
of places with as few edits the first counts; extra columns stay where rows are kept; empty tables match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.arrays import BYTE_VALUES, U64, grams
from tokenlake.llm.store import Scratch, text_batches

SCHEMA = "doc_id long, item_id long, start long, edits int, n_bytes int"

#: Characters that are normalised, and bytes that are looked through, at a time.
PIECE = 1 << 20
_OTHER = re.compile(r"[\W_]+")
_GAP = re.compile(r"\s")
#: Thai to Burmese, Khmer, and Chinese and Japanese: written without spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


@dataclass(frozen=True)
class Plan:
    """q: bytes of a gram; percent: edits allowed, of an item's bytes; least: shortest item for which edits are allowed; block_bytes: items held at a time."""

    q: int = 12
    percent: int = 5
    least: int = 20
    block_bytes: int = 8 << 20


def normalise(text: str | None) -> bytes:
    """Lower case; letters and digits stay, everything between them is one space; none at the ends. A long text is cut at white space."""
    text, parts, at = text or "", [], 0
    while at < len(text):
        found = _GAP.search(text, at + PIECE)
        end = found.start() if found else len(text)
        if part := _OTHER.sub(" ", text[at:end].lower()).strip().encode():
            parts.append(part)
        at = end
    return b" ".join(parts)


def bounded(text: bytes, start: int, end: int) -> bool:
    """Does text[start:end], whole characters, begin and end at word boundaries of a normalised text?"""

    def boundary(at: int) -> bool:
        beside = text[max(0, at - 4) : at].decode(errors="ignore")[-1:], text[at : at + 4].decode(errors="ignore")[:1]
        return "" in beside or " " in beside or any(map(_UNSPACED.match, beside))

    return boundary(start) and boundary(end)


class Items:
    """The q-grams of a block of benchmark items, and its short items by length."""

    def __init__(self, ids: list[int | None], texts: list[bytes], plan: Plan = Plan()):
        rows = list(zip(ids, texts, strict=True))
        kept = [(i, t) for i, t in rows if len(t) >= plan.least]
        low = [(i, t) for i, t in rows if 0 < len(t) < plan.least]
        self.plan, self.ids, self.texts = plan, [i for i, _ in kept + low], [t for _, t in kept + low]
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for k, (_, t) in enumerate(low, len(kept)):
            self.short.setdefault(len(t), {}).setdefault(t, []).append(k)
        self.short_keys = {n: np.unique([grams(BYTE_VALUES[np.frombuffer(t, np.uint8)], n)[0] for t in by]) for n, by in self.short.items()}
        self.size = np.array([len(t) for _, t in kept], np.int64)
        room = np.maximum((self.size - plan.q) // plan.q, 0)
        self.edits = np.minimum(self.size * plan.percent // 100, room)
        self.need = np.maximum(self.size - plan.q + 1 - self.edits * plan.q, 1)
        hashes, item, place = [], [], []
        for k, (_, t) in enumerate(kept):
            h = grams(BYTE_VALUES[np.frombuffer(t, np.uint8)], plan.q)
            hashes.append(h)
            item.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        self.hash = np.concatenate([*hashes, np.zeros(0, U64)])
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.item, self.place = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)[order] for x in (item, place))
        self.keys, self.first = np.unique(self.hash, return_index=True)
        self.first = np.append(self.first, len(self.hash))
        self.shift = U64(64 - max(16, (16 * len(self.keys)).bit_length()))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[(self.keys >> self.shift).astype(np.int64)] = True
        #: distance of two bands' first diagonals; a band is as much wider as edits are allowed
        self.step = np.maximum(16, 2 * self.edits)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, band) with enough shared q-grams; band b of an item begins at diagonal b * step - its size."""
        none = np.zeros(0, np.int64)
        if not len(self.keys) or len(data) < self.plan.q:
            return none, none, none
        h = grams(BYTE_VALUES[data], self.plan.q)
        at = np.flatnonzero(self.bitmap[(h >> self.shift).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[place] == h[at]
        at, place = at[same], place[same]
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + self.plan.q <= offsets[doc + 1]
        at, place, doc = at[inside], place[inside], doc[inside]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # documents are taken a few at a time so that the postings of frequent q-grams stay bounded
        many = self.first[place + 1] - self.first[place]
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + 4_000_000, 4_000_000))
        cuts = np.unique(np.append([np.searchsorted(at, offsets[doc[c]]) if c < len(at) else len(at) for c in cuts], [0, len(at)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = many[a:b]
            post = np.repeat(self.first[place[a:b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, where = self.item[post], np.repeat(at[a:b], n)
            own = np.repeat(doc[a:b], n)
            diagonal = where - offsets[own] - self.place[post] + self.size[item]
            band, rest = np.divmod(diagonal, self.step[item])
            too = (rest <= self.edits[item]) & (band > 0)
            own, item, band = np.append(own, own[too]), np.append(item, item[too]), np.append(band, band[too] - 1)
            key = np.stack([own, item, band], 1)
            order = np.lexsort((band, item, own))
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]).any(1)
            starts = np.flatnonzero(new)
            count = np.diff(np.append(starts, len(key)))
            good = key[starts][count >= self.need[key[starts, 1]]]
            out.append((good[:, 0], good[:, 1], good[:, 2]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)

    def align(self, text: bytes, item: int, band: int) -> tuple[int, int]:
        """(edits, start) of the item's best place within a band of the text, free at both ends of the text."""
        t, m, k = self.texts[item], int(self.size[item]), int(self.edits[item])
        low = int(band * self.step[item]) - m - k
        width = int(self.step[item]) + 3 * k + 1
        window = text[max(0, low) : low + width + m]
        if (found := window.find(t)) >= 0:
            return 0, max(0, low) + found
        if not k:
            return m, 0
        far = 1 << 20
        codes = np.full(width + m, 256, np.int32)
        part = np.frombuffer(text[max(0, low) : max(0, low + width + m)], np.uint8)
        codes[max(0, -low) : max(0, -low) + len(part)] = part
        needle = np.frombuffer(t, np.uint8)
        line, steps = np.zeros(width, np.int32), np.arange(width, dtype=np.int32)
        for i in range(m):
            new = line + (codes[i : i + width] != needle[i])
            new[:-1] = np.minimum(new[:-1], line[1:] + 1)
            line = np.minimum.accumulate(new - steps) + steps
            if line.min() > k:
                return far, 0
        best = int(line.argmin())
        return int(line[best]), max(0, low + best)

    def verbatim(self, texts: list[bytes], pieces: list[tuple[int, int]], data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item): (0, start) of the first place of each short item; pieces: the text and the start of each range of data."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for n, by in self.short.items():
            h, keys = grams(BYTE_VALUES[data], n), self.short_keys[n]
            at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h)
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = at + n <= offsets[doc + 1]
            for p, i in zip(doc[inside].tolist(), at[inside].tolist(), strict=True):
                same = by.get(data[i : i + n].tobytes(), [])
                d, start = pieces[p][0], pieces[p][1] + i - int(offsets[p])
                if same and (d, same[0]) not in out and bounded(texts[d], start, start + n):
                    out.update({(d, k): (0, start) for k in same})
        return out

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, start, edits): the best place of each item that stands in a text."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        reach = self.plan.least + int((self.size + 2 * self.edits).max(initial=0))
        every = [(d, at) for d, t in enumerate(texts) for at in range(0, max(1, len(t) - reach), PIECE)]
        lo = 0
        while lo < len(every):
            part, size, hi = [], 0, lo
            while hi < len(every) and size < PIECE:
                d, at = every[hi]
                part.append(texts[d][at : at + PIECE + reach] if len(texts[d]) > PIECE + reach or at else texts[d])
                size += len(part[-1])
                hi += 1
            self._within(texts, every[lo:hi], part, best)
            lo = hi
        return [(d, i, start, edits) for (d, i), (edits, start) in sorted(best.items())]

    def _within(self, texts: list[bytes], pieces: list[tuple[int, int]], parts: list[bytes], best: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Put the best places in some pieces of the texts among the best so far."""
        offsets = np.cumsum([0, *(len(t) for t in parts)])
        data = np.frombuffer(b"".join(parts), np.uint8)
        for key, place in self.verbatim(texts, pieces, data, offsets).items():
            best[key] = min(best.get(key, place), place)
        for p, item, band in zip(*(x.tolist() for x in self.candidates(data, offsets)), strict=True):
            d, at = pieces[p]
            if best.get((d, item), (1,))[0] == 0:
                continue
            edits, start = self.align(parts[p], item, band)
            if edits <= self.edits[item]:
                place = (edits, at + start)
                best[d, item] = min(best.get((d, item), place), place)


def _blocks(items: DataFrame, plan: Plan, scratch: Scratch) -> Iterator[tuple[Items, bool]]:
    """(block of items, is it the only one) for one block after the other; of the driver's memory each asks about block_bytes."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // plan.block_bytes))
    if n > 1:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
        dealt.repartition(n, "block").write.partitionBy("block").parquet(f"{scratch.root}/items")
        rows = rows.sparkSession.read.schema(dealt.schema).parquet(f"{scratch.root}/items")
    for k in range(n):
        part = (rows.filter(F.col("block") == k) if n > 1 else rows).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in part], [normalise(r["text"]) for r in part], plan), n == 1


def contaminated(docs: DataFrame, items: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """SCHEMA: a row for each item(item_id, text) that stands in a row of docs(doc_id, text), at its best place.

    start and n_bytes are in the normalised text; documents without a match give no row.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch, out = Scratch(spark, "decontamination"), None
    for k, (block, alone) in enumerate(_blocks(items, plan, scratch)):
        shared = spark.sparkContext.broadcast(block)  # at most block_bytes of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [(batch.column(0)[d].as_py(), shared.value.ids[i], s, e, len(shared.value.texts[i])) for d, i, s, e in _found(batch, 1, shared.value)]
                cols = list(zip(*got, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["doc_id", "item_id", "start", "edits", "n_bytes"])

        part = rows.mapInArrow(run, SCHEMA)
        if not alone:
            part = scratch.write(part, f"found-{k}")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _found(batch: pa.RecordBatch, column: int, items: Items) -> Iterator[tuple[int, int, int, int]]:
    texts = batch.column(column).to_pylist()
    lo = 0
    while lo < len(texts):
        part, size, hi = [], 0, lo
        while hi < len(texts) and (hi == lo or size < 1 << 20):
            part.append(normalise(texts[hi]))
            size += len(part[-1])
            hi += 1
        for d, i, start, edits in items.find(part):
            yield lo + d, i, start, edits
        lo = hi


def drop_contaminated(docs: DataFrame, items: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of docs(text, ...) in which no item stands, with all their columns; no shuffle with one block of items."""
    spark = docs.sparkSession
    text_batches(spark)
    schema, column, scratch = docs.schema, docs.columns.index("text"), Scratch(spark, "decontamination")
    for k, (block, alone) in enumerate(_blocks(items, plan, scratch)):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, *_ in _found(batch, column, shared.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
        if not alone:
            docs = scratch.write(docs, f"clean-{k}")
            shared.destroy()
            scratch.drop(*([f"clean-{k - 1}"] if k else []))
    return docs
