"""Collocations: phrases whose words stand together more often than apart, by position bitmaps per word.

Shards. A task lays the words of its documents end to end, `shard_words` at a time, two further words
being read along so that no phrase is lost between shards. A shard keeps one compressed bitmap for each
frequent word: the blocks of 8 places in which the word stands, each with a mask of its places. One
more bitmap has the places where a piece begins.

Extension. The bitmap of a phrase has its last words' places. Shifted by one place, without the places
where pieces begin, and ANDed with the bitmap of each word that has the same block, it becomes the
bitmaps of the phrases that are one word longer; popcounts are their frequencies. Phrases are extended
depth first: the extensions of a batch of words go to full length before the next batch. All counts of
shards are sums of popcounts, summed again over shards in a shuffle.

Pruning. A phrase is as frequent as the candidates ask only if all its parts are. Words first, then
pairs, are counted over all shards, and those frequent enough become a bitmap of hashes of bounded size
(`bits`) that tasks test by; whatever it lets through wrongly falls to the exact count afterwards. Before
pairs are extended, places that stand in no frequent pair are taken out of the bitmaps.

Words and pairs are told apart by 64-bit hashes of language and words. Scores are exact, in decimals.

Defined results: a null text is empty, a null language is `und` and one with the language of that name;
doc_id is not read, so rows that repeat it, null or not, are documents of their own; texts without words and empty tables
give nothing; ties in rank go by a, then by the phrase's bytes. A text of any length is taken whole: beside itself it costs
its words' places and hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.llm.arrays import BASE, LOWER, U64, Words, hash_runs, mix, ranges, texts
from tokenlake.llm.hash_filter import Filter
from tokenlake.llm.store import Scratch, text_batches

SPLITS = np.zeros(256, bool)
SPLITS[list(b".,;:!?\n\x0b\x0c\r")] = True
APART = SPLITS.copy()
APART[[0x20, 0x09]] = True


@dataclass(frozen=True)
class Plan:
    """least: occurrences of a candidate; percent: a candidate within a longer one of at least this share of its occurrences goes;
    top: rows for each language; shard_words: places of a shard, a multiple of 8; counted: words
    that a task counts before it hands on; step: bytes of text that are split at once;
    cells: pairs of bitmap blocks that are ANDed at once; bits: most bits of a bitmap of hashes, as a power of two."""

    least: int = 10
    percent: int = 50
    top: int = 2000
    shard_words: int = 1 << 19
    counted: int = 1 << 21
    step: int = 1 << 20
    cells: int = 1 << 21
    bits: int = 27


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a pair."""
    return mix(mix(a) * U64(BASE) + b)


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Names and hashes, one for each row."""
    names = ["und" if x is None else x for x in column.to_pylist()]
    known = {x: hash_runs(np.frombuffer(b" " + x.encode(), np.uint8), np.array([len(x.encode()) + 1]), 1)[0] for x in set(names)}
    return names, np.array([known[x] for x in names], U64)


@dataclass
class Step:
    """Some whole documents: their words, with text, keys, whether a piece begins there, and languages by document."""

    words: Words
    data: np.ndarray
    keys: np.ndarray
    opens: np.ndarray
    langs: list[str]

    def named(self, at: np.ndarray) -> list[pa.Array]:
        """Languages and lower-cased words at some places."""
        length = self.words.length[at].astype(np.int64)
        chars = LOWER[self.data[ranges(self.words.start[at], length)]]
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        word = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(chars)).cast(pa.string())
        return [pa.array([self.langs[d] for d in self.words.doc[at]], pa.string()), word]


def _steps(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[Step]:
    """Of (lang, text) rows."""
    for batch in batches:
        names, hashed = _languages(batch.column(0))
        for lo, hi, data, offsets in texts(batch, "text", plan.step):
            words = Words(data, offsets, lower=True, is_space=APART)
            piece = np.searchsorted(np.flatnonzero(SPLITS[data]), words.start)
            opens = np.ones(len(piece), bool)
            opens[1:] = (piece[1:] != piece[:-1]) | (words.doc[1:] != words.doc[:-1])
            yield Step(words, data, mix(words.hash + hashed[lo:hi][words.doc]), opens, names[lo:hi])


def _word_counts(plan: Plan):
    """(lang, key, n): rows with a key count a word, the others all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, sizes = [], 0, Counter()

        def out() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate([np.zeros(0, U64), *held]), return_counts=True)
            key = pa.array([None] * len(sizes) + key.view(np.int64).tolist(), pa.int64())
            lang = pa.array(list(sizes) + [None] * (len(key) - len(sizes)), pa.string())
            count = pa.array([*sizes.values(), *count.tolist()], pa.int64())
            held.clear()
            sizes.clear()
            return pa.RecordBatch.from_arrays([lang, key, count], ["lang", "key", "n"])

        for step in _steps(batches, plan):
            held.append(step.keys)
            n += len(step.keys)
            for d, size in enumerate(np.bincount(step.words.doc, minlength=len(step.langs)).tolist()):
                sizes[step.langs[d]] += size
            if n >= plan.counted:
                yield out()
                n = 0
        yield out()

    return run


def _shards(steps: Iterator[tuple[np.ndarray, np.ndarray]], plan: Plan, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(keys of words, where pieces begin, own places): phrases that begin in the own places are this shard's."""
    keys, opens = np.zeros(0, U64), np.zeros(0, bool)
    for more in steps:
        keys, opens = np.concatenate([keys, more[0]]), np.concatenate([opens, more[1]])
        at = 0
        while len(keys) - at >= plan.shard_words + reach:
            end = at + plan.shard_words
            yield keys[at : end + reach], opens[at : end + reach], plan.shard_words
            at = end
        keys, opens = keys[at:], opens[at:]
    if len(keys):
        yield keys, opens, len(keys)


@dataclass
class Bitmaps:
    """Compressed bitmaps: of[i] has the places mask[i] of the 8 of block[i]. An owner may have a block twice, with other places."""

    of: np.ndarray
    block: np.ndarray
    mask: np.ndarray

    def __getitem__(self, some) -> Bitmaps:
        return Bitmaps(self.of[some], self.block[some], self.mask[some])

    def shifted(self, without: np.ndarray) -> Bitmaps:
        """One place later, but for the places of a plain bitmap."""
        wide = self.mask.astype(np.uint16) << 1
        over = np.flatnonzero(wide >> 8)
        over = over[self.block[over] + 1 < len(without)]
        of = np.concatenate([self.of, self.of[over]])
        block = np.concatenate([self.block, self.block[over] + 1])
        mask = np.concatenate([wide & 0xFF, np.ones(len(over), np.uint16)]).astype(np.uint8) & ~without[block]
        return Bitmaps(of, block, mask)[mask != 0]


class Shard:
    """Position bitmaps of the words of a shard; those with key 0 have none."""

    def __init__(self, keys: np.ndarray, opens: np.ndarray):
        blocks = (len(keys) + 7) // 8
        at = np.flatnonzero(keys)
        at = at[np.argsort(keys[at], kind="stable")]
        new = np.append(True, keys[at][1:] != keys[at][:-1])[: len(at)]
        self.key, word, block = keys[at[new]], np.cumsum(new) - 1, at >> 3
        first = np.flatnonzero(new | np.append(True, block[1:] != block[:-1])[: len(at)])
        bit = np.left_shift(np.uint8(1), (at & 7).astype(np.uint8))
        self.words = Bitmaps(word[first], block[first], np.bitwise_or.reduceat(bit, first) if len(at) else bit)
        padded = np.zeros(blocks * 8, bool)
        padded[: len(opens)] = opens
        self.opens = np.packbits(padded, bitorder="little")
        # the same bitmaps by block, to find those that can have a place in common with a phrase: in the order of their first places
        number = np.full(len(keys), -1)
        number[at[first]] = np.arange(len(first))
        self.by_block = self.words[number[number >= 0]]
        self.edge = np.append(0, np.cumsum(np.bincount(self.by_block.block, minlength=blocks)))

    def extended(self, phrases: Bitmaps, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Bitmaps]:
        """(phrase, next word, count) of the phrases one word longer, and their bitmaps, numbered in that order."""
        phrases = phrases.shifted(self.opens)
        width = (self.edge[1:] - self.edge[:-1])[phrases.block]
        total, got, a = np.cumsum(width), [], 0
        while a < len(width):
            b = max(a + 1, int(np.searchsorted(total, total[a] - width[a] + cells, "right")))
            other = ranges(self.edge[phrases.block[a:b]], width[a:b])
            owner = np.repeat(np.arange(a, b), width[a:b])
            both = phrases.mask[owner] & self.by_block.mask[other]
            some = np.flatnonzero(both)
            got.append((phrases.of[owner[some]], self.by_block.of[other[some]], phrases.block[owner[some]], both[some]))
            a = b
        if not got:
            none = np.zeros(0, np.int64)
            return none, none, none, phrases
        of, word, block, mask = (np.concatenate(x) for x in zip(*got, strict=True))
        pair, number = np.unique(of * len(self.key) + word, return_inverse=True)
        n = np.bincount(number, np.bitwise_count(mask), len(pair)).astype(np.int64)
        return pair // len(self.key), pair % len(self.key), n, Bitmaps(number, block, mask)

    def phrases(self, own: int, length: int, frequent_pairs, cells: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """(keys of the words, count) of phrases of 2 to length words that begin in the first own places, depth first.
        frequent_pairs: which keys of pairs can be frequent, or None for all pairs."""
        blocks, last = own >> 3, own & 7
        inside = np.full(len(self.opens), 0xFF, np.uint8)
        inside[blocks:] = 0
        if last:
            inside[blocks] = (1 << last) - 1
        words = Bitmaps(self.words.of, self.words.block, self.words.mask & inside[self.words.block])
        words = words[words.mask != 0]
        width = (self.edge[1:] - self.edge[:-1])[words.block]
        total = np.cumsum(width)
        a = 0
        while a < len(width):  # whole words at a time
            b = max(a + 1, int(np.searchsorted(total, total[a] - width[a] + cells, "right")))
            b = int(np.searchsorted(words.of, words.of[b - 1], "right"))
            yield from self._deeper([self.key], words[a:b], length - 1, frequent_pairs, cells)
            a = b

    def _deeper(self, parts: list[np.ndarray], bitmaps: Bitmaps, more: int, frequent_pairs, cells: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """parts: the keys of each phrase's words, by the phrase's number."""
        phrase, word, n, bitmaps = self.extended(bitmaps, cells)
        if not len(n):
            return
        parts = [x[phrase] for x in parts] + [self.key[word]]
        if frequent_pairs is not None:
            good = frequent_pairs(joined(parts[-2], parts[-1]))
            number = np.cumsum(good) - 1
            some = good[bitmaps.of]
            parts, n = [x[good] for x in parts], n[good]
            bitmaps = Bitmaps(number[bitmaps.of[some]], bitmaps.block[some], bitmaps.mask[some])
        if len(n):
            yield parts, n
            if more > 1:
                yield from self._deeper(parts, bitmaps, more - 1, frequent_pairs, cells)


def _pair_counts(plan: Plan, words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = ((np.where(words.value(step.keys), step.keys, U64(0)), step.opens) for step in _steps(batches, plan))
        for keys, opens, own in _shards(steps, plan, 1):
            for (a, b), n in Shard(keys, opens).phrases(own, 2, None, plan.cells):
                yield pa.RecordBatch.from_arrays([pa.array(joined(a, b).view(np.int64)), pa.array(n.astype(np.int32))], ["key", "n"])

    return run


def _phrase_counts(plan: Plan, words, pairs):
    """(k1, k2, k3, n, lang, word): phrases of two or three words, and under k1 alone the names of the words in them."""
    columns = ["k1", "k2", "k3", "n", "lang", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[pa.RecordBatch] = []
        seen = np.zeros(0, U64)

        def steps() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal seen
            for step in _steps(batches, plan):
                good = words.value(step.keys)
                pair = good[1:] & good[:-1] & ~step.opens[1:]
                pair[pair] = pairs.value(joined(step.keys[:-1][pair], step.keys[1:][pair]))
                active = np.append(pair, False) | np.append(False, pair) if len(good) else good
                at = np.flatnonzero(active)
                key, first = np.unique(step.keys[at], return_index=True)
                new = ~np.isin(key, seen, assume_unique=True)
                seen = np.union1d(seen, key[new]) if len(seen) < 1 << 20 else key
                key, at = key[new], at[first[new]]
                none = pa.nulls(len(key), pa.int64())
                names.append(pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), none, none, pa.array(np.zeros(len(key), np.int32)), *step.named(at)], columns))
                yield np.where(active, step.keys, U64(0)), step.opens

        for keys, opens, own in _shards(steps(), plan, 2):
            for parts, n in Shard(keys, opens).phrases(own, 3, pairs.value, plan.cells):
                keyed = [pa.array(x.view(np.int64)) for x in parts] + [pa.nulls(len(n), pa.int64())] * (3 - len(parts))
                yield pa.RecordBatch.from_arrays([*keyed, pa.array(n.astype(np.int32)), pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.string())], columns)
            yield from names
            names.clear()
        yield from names

    return run


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exactly, of counts below 10**15."""
    big = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"({big(a)} * {big(a)} * 1000000bd) div ({big(left)} * {big(right)})")


def collocations(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of two and three words of each language of docs(lang, text)."""
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "collocations")
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = docs.mapInArrow(_word_counts(plan), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("f"))
    counted = scratch.write(counted.filter(F.col("key").isNull() | (F.col("f") >= plan.least)), "counted")
    words, sizes = counted.filter("key is not null").select("key", "f"), counted.filter("key is null").select("lang", F.col("f").alias("n"))
    known = spark.sparkContext.broadcast(Filter.of(words, plan.bits))

    pairs = docs.mapInArrow(_pair_counts(plan, known), "key long, n int").groupBy("key").agg(F.sum("n").alias("f"))
    often = scratch.write(pairs.filter(F.col("f") >= plan.least).select("key"), "often")
    linked = spark.sparkContext.broadcast(Filter.of(often, plan.bits))

    found = docs.mapInArrow(_phrase_counts(plan, known, linked), "k1 long, k2 long, k3 long, n int, lang string, word string")
    found = found.groupBy("k1", "k2", "k3").agg(F.sum("n").alias("a"), F.max("lang").alias("lang"), F.max("word").alias("word"))
    found = scratch.write(found.filter(F.col("k2").isNull() | (F.col("a") >= plan.least)), "found")
    known.destroy()
    linked.destroy()
    named = found.filter("k2 is null").select(F.col("k1").alias("key"), "lang", "word").join(words, "key")
    return ranked(named, sizes, found.filter("k2 is not null").select("k1", "k2", "k3", "a"), scratch, plan)


def ranked(words: DataFrame, sizes: DataFrame, phrases: DataFrame, scratch: Scratch, plan: Plan) -> DataFrame:
    """The result from words(lang, word, key, f), sizes(lang, n) and phrases(k1, k2, k3, a)."""
    spark = words.sparkSession
    first = words.select(F.col("key").alias("k1"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1"))
    second = words.select(F.col("key").alias("k2"), F.col("word").alias("w2"), F.col("f").alias("f2"))
    two = phrases.filter("k3 is null").drop("k3").hint("merge").join(first, "k1").hint("merge").join(second, "k2")
    two = scratch.write(two, "two")
    left = two.select("k1", "k2", "lang", "w1", "w2", "f1", F.col("a").alias("f12"))
    right = two.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    three = phrases.filter("k3 is not null").hint("merge").join(left, ["k1", "k2"]).hint("merge").join(right, ["k2", "k3"])
    three = scratch.write(three, "three")

    within = three.select("k1", "k2", "a").union(three.select("k2", "k3", "a")).groupBy("k1", "k2").agg(F.max("a").alias("longer"))
    kept = two.hint("merge").join(within, ["k1", "k2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < plan.percent * F.col("a")))
    pairs = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))
    cut = three.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    early = F.col("s1") <= F.col("s2")
    triples = cut.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    scored = scratch.write(pairs.union(triples), "scored")
    # ranks by ranges of the order: no task sees a whole language
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.write(scored.repartitionByRange(parts, F.col("lang").asc(), *order).withColumn("part", F.spark_partition_id()), "dealt")
    before = dealt.groupBy("lang", "part").agg(F.count("*").alias("size"))  # a row for each language and range
    before = before.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = before.filter(F.col("before") < plan.top).select("lang", "part", "before").join(sizes, "lang")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    best = dealt.join(near, ["lang", "part"]).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= plan.top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
