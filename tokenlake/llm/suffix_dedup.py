"""Suffix-array deduplication of byte strings.

Which 200-byte strings stand twice is decided by suffix arrays; the corpus is first brought into
shards in which every string meets all its equals:

1. Content-defined blocks (tokenlake.llm.blocks) of all texts; only blocks whose anchor stands at
   least twice, with equal bytes on one side, can hold a repeated string. Blocks with equal content
   are one block with a count.
2. The bytes of each distinct block go to a shard of at most about `shard_bytes`; a shard holds whole
   anchors. Each gets its suffix array (Larsson-Sadakane) and its common prefixes (Kasai). Suffixes
   between two prefixes shorter than the window form one string, whose occurrences are the counts of
   the blocks it starts in.
3. An anchor with more block bytes than that is hot: its blocks are dealt by content over as many
   shards as it needs, in as many tasks. These shards are merged by binary search. Each names its
   distinct strings by a digest; digests that several shards name give needles, the strings
   themselves, and every such shard looks them up in its suffix array.
4. Strings with two or more occurrences, or found in two shards, are marked in every block that
   holds them, and the marked bytes are cut from the texts.

A task holds one shard's arrays and one document at a time; partitions are as many as the block
bytes ask for. Long texts are taken in segments, their blocks in pieces.

Defined results: a null text is empty; repeated rows count as further occurrences, and their blocks
are listed once; null ids pass
through; an empty table gives an empty one; extra columns pass through in `rest`.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.llm import blocks
from tokenlake.llm.arrays import BYTE_VALUES, covered, fields, grams, ranges, texts
from tokenlake.llm.store import Scratch, text_batches
from tokenlake.llm.suffix_arrays import common_prefixes, eights, locate, suffix_array


@dataclass(frozen=True)
class Plan:
    """window: bytes that must repeat; gram: bytes of an anchor; shard_bytes: most bytes of one suffix array, and of an
    anchor that is not hot; partition_bytes: block bytes of a task; piece: blocks of a document that travel in one row."""

    window: int = 200
    gram: int = 32
    shard_bytes: int = 1 << 19
    partition_bytes: int = 16 << 20
    piece: int = 20_000


def _found(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rk = batch.column(0).to_numpy()
            for lo, hi, data, offsets in texts(batch, "text"):
                got = blocks.find(data, offsets, plan.window, plan.gram, sides=True, table=BYTE_VALUES)
                small = [pa.array(got[k].astype(np.int32)) for k in ("a", "n", "left", "right")]
                yield pa.RecordBatch.from_arrays([pa.array(rk[lo:hi][got["doc"]]), pa.array(got["anchor"]), pa.array(got["body"]), *small], ["rk", "anchor", "body", "a", "n", "l", "r"])

    return run


def cut(raw: bytes, gone: np.ndarray | None) -> tuple[int, int, int, str, bytes]:
    """(bytes, bytes removed, removed runs, hash of the rest, the rest)."""
    if gone is None:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept


_OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
_BLOCK = "struct<anchor:long,body:long,shard:int,shards:int,count:long,n:int,bytes:binary>"


def _half(plan: Plan, with_bytes: bool):
    """Finish texts without shared blocks; pack the others. The bytes of the blocks that a text stands for follow in rows of their own."""
    numbers = [("anchor", pa.int64()), ("body", pa.int64()), ("shard", pa.int32()), ("shards", pa.int32()), ("count", pa.int64()), ("n", pa.int32())]
    block_type = pa.struct([*numbers, ("bytes", pa.binary())])
    names = ["rk", "rest", *(x.split()[0] for x in _OUT.split(", ")), "z", "blocks"]

    def sent(todo: pa.ListArray, i: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        a, stands, *values = fields(todo, i, "a", "stands", *(k for k, _ in numbers))
        at = np.flatnonzero(stands.astype(bool))
        for k in range(0, len(at), plan.piece):
            of = at[k : k + plan.piece]
            starts, n = a[of].tolist(), values[-1][of].tolist()
            cols = [pa.array(v[of], t) for v, (_, t) in zip(values, numbers, strict=True)]
            block = pa.StructArray.from_arrays([*cols, pa.array([raw[x : x + m - 1 + plan.window] for x, m in zip(starts, n, strict=True)], pa.binary())], fields=list(block_type))
            yield pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            todo = batch.column(3)
            for i, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode()
                row: list = [None] * 6
                if todo[i].is_valid:
                    row[5] = press.compress(raw)
                    for piece in sent(todo, i, raw):
                        none = [pa.nulls(1, t) for t in (pa.int64(), batch.schema.field(2).type, *_KINDS, pa.binary())]
                        yield pa.RecordBatch.from_arrays([*none, piece], names)
                else:
                    row[:5] = cut(raw, None)
                    row[4] = raw if with_bytes else None
                for k, x in enumerate(row):
                    out[k].append(x)
            cols = [pa.array(x, t) for x, t in zip(out, [*_KINDS, pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols, pa.nulls(batch.num_rows, pa.list_(block_type))], names)

    return run


class Shard:
    """The suffix array of some blocks laid end to end, and the occurrences of each of their windows."""

    def __init__(self, parts: list[bytes], counts: np.ndarray, n: np.ndarray, window: int):
        size = np.array([len(x) for x in parts], np.int64)
        self.first = np.cumsum(size) - size
        self.n, self.window = n, window
        self.text = np.frombuffer(b"".join(parts), np.uint8)
        self.sa = suffix_array(self.text)
        self.key = eights(self.text, window + 16)
        string = np.cumsum(common_prefixes(self.text, self.sa, self.key) < window)
        self.starts = ranges(self.first, n)
        self.place = np.empty(len(self.text), np.int64)
        self.place[self.sa] = string
        self.string = self.place[self.starts]
        weight = np.zeros(len(self.text), np.int64)
        weight[self.starts] = np.repeat(counts, n)
        self.sums = np.concatenate([[0], np.cumsum(weight[self.sa])])
        self.total = np.bincount(self.string, np.repeat(counts, n), int(string[-1]) + 1).astype(np.int64)

    def distinct(self) -> np.ndarray:
        """The place of one start of each of the shard's strings."""
        return self.starts[np.unique(self.string, return_index=True)[1]]

    def merge(self, needles: list[tuple[bytes, list[int]]]) -> None:
        """Count an occurrence elsewhere for each window that begins at some places of some blocks and is a window here."""
        raw = np.frombuffer(b"".join(x for x, _ in needles), np.uint8)
        base = np.cumsum([0, *(len(x) for x, _ in needles[:-1])])
        at = np.concatenate([b + np.array(x) for b, (_, x) in zip(base, needles, strict=True)])
        needles = eights(raw, self.window)[at[:, None] + 8 * np.arange(-(-self.window // 8))]
        lo, hi = locate(needles, self.window, self.text, self.sa, self.key)
        # suffixes that only begin so across a block's end carry no weight
        found = self.sums[hi] > self.sums[lo]
        np.add.at(self.total, self.place[self.sa[lo[found]]], 1)

    def repeated(self) -> list[bytes]:
        """For each block a bitmap of its window starts that stand twice or more."""
        twice = self.total[self.string] >= 2
        ends = np.cumsum(self.n)
        return [np.packbits(twice[b - k : b]).tobytes() if twice[b - k : b].any() else b"" for b, k in zip(ends.tolist(), self.n.tolist(), strict=True)]


def _shards(plan: Plan, batches: Iterator[pa.RecordBatch], apart: bool) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """(blocks, needles) of one shard after the other, from rows sorted by anchor and shard; equal blocks come once.

    A shard of its own for each (anchor, shard) if apart, else whole anchors up to shard_bytes. Needles
    are the rows without a body: a block of another shard and the windows of it to look for.
    """
    group: list[tuple] = []
    own: list[tuple] = []
    needles: list[tuple] = []
    size, last = 0, None
    every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for row in itertools.chain(every, [()]):
        if row[:2] != last:
            last = row[:2]
            if own and apart:
                yield own, needles
            elif own:
                more = sum(len(x[5]) for x in own)
                if group and size + more > plan.shard_bytes:
                    yield group, []
                    group, size = [], 0
                group.extend(own)
                size += more
            own, needles = [], []
        if row and row[2] is None:
            needles.append(row[5:])
        elif row and (not own or own[-1][2] != row[2]):
            own.append(row)
    if group:
        yield group, []


def _shard(plan: Plan, rows: list[tuple]) -> Shard:
    return Shard([x[5] for x in rows], np.array([x[3] for x in rows], np.int64), np.array([x[4] for x in rows], np.int64), plan.window)


def _judged(plan: Plan, apart: bool):
    """(anchor, body, marks): the blocks' windows that stand twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, needles in _shards(plan, batches, apart):
            shard = _shard(plan, rows)
            for k in range(0, len(needles), 512):
                shard.merge(needles[k : k + 512])
            maps = shard.repeated()
            hit = [k for k, m in enumerate(maps) if m]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[k][0] for k in hit], pa.int64()), pa.array([rows[k][2] for k in hit], pa.int64()), pa.array([maps[k] for k in hit], pa.binary())], ["anchor", "body", "marks"]
            )

    return run


def _named(plan: Plan):
    """(anchor, shard, body, at, f1, f2): the digest and a place of each distinct string of a hot anchor's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _shards(plan, batches, True):
            shard = _shard(plan, rows)
            at = shard.distinct()
            block = np.searchsorted(shard.first, at, "right") - 1
            values = BYTE_VALUES[shard.text]
            f1, f2 = (grams(values, plan.window, seed=k)[at].view(np.int64) for k in (0, 1))
            body = np.array([x[2] for x in rows], np.int64)[block]
            cols = [np.full(len(at), rows[0][0]), np.full(len(at), rows[0][1], np.int32), body, (at - shard.first[block]).astype(np.int32), f1, f2]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["anchor", "shard", "body", "at", "f1", "f2"])

    return run


def _rest(plan: Plan, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, z in enumerate(batch.column(1)):
                raw = open_.decompress(z.as_py())
                gone = None
                if batch.column(2)[i].is_valid:
                    a, marks = fields(batch.column(2), i, "a", "marks")
                    at = np.concatenate([x + np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8))) for x, m in zip(a.astype(np.int64), marks, strict=True)])
                    gone = covered(len(raw), at, at + plan.window)
                for k, x in enumerate(cut(raw, gone)):
                    out[k].append(x)
            if not with_bytes:
                out[4] = [None] * len(out[4])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, _KINDS, strict=True))], ["rest", *(x.split()[0] for x in _OUT.split(", "))])

    return run


def suffix_dedup(docs: DataFrame, plan: Plan = Plan(), with_bytes: bool = False) -> DataFrame:
    """(rest, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes) for each row of docs(doc_id, text, ...)."""
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "suffix-dedup")
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("rk"), F.col("text").cast("string").alias("text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"))
    found = scratch.write(rows.select("rk", "text").mapInArrow(_found(plan), "rk long, anchor long, body long, a int, n int, l int, r int"), "found")
    # written on its own, so that the join's sides are plain exchanges and a frequent anchor can be split
    shared = scratch.write(found.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    near = scratch.write(found.join(shared, "anchor"), "near")
    scratch.drop("found")
    lefts, rights = (scratch.write(near.filter(f"{k} > 0").groupBy("anchor", k).count().filter("count > 1").select("anchor", k, F.lit(True).alias(f"{k}_twice")), k) for k in ("l", "r"))
    either = near.join(lefts, ["anchor", "l"], "left").join(rights, ["anchor", "r"], "left").filter("l_twice or r_twice")
    some = scratch.write(either.select("rk", "anchor", "body", "a", "n"), "shared")
    scratch.drop("near", "anchors", "l", "r")
    bodies = some.groupBy("anchor", "body").agg(F.count("*").alias("count"), F.min(F.struct("rk", "a")).alias("first"), F.min("n").alias("n"))
    bodies = scratch.write(bodies, "bodies")
    heat = bodies.groupBy("anchor").agg(F.sum(F.col("n") + plan.window).alias("size"))
    hot = scratch.write(heat.filter(F.col("size") > plan.shard_bytes).select("anchor", F.ceil(F.col("size") / plan.shard_bytes).cast("int").alias("shards")), "hot")
    placed = bodies.join(hot, "anchor", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    placed = placed.withColumn("shard", F.pmod(F.col("body"), F.col("shards")).cast("int")).drop("n")
    parts = bodies.agg(F.sum(F.col("n") + plan.window)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts // plan.partition_bytes))
    stands = ((F.col("first.rk") == F.col("rk")) & (F.col("first.a") == F.col("a"))).alias("stands")
    listed = some.join(placed, ["anchor", "body"]).select("rk", F.struct("anchor", "body", "shard", "shards", "count", "a", "n", stands).alias("block"))
    per = listed.groupBy("rk").agg(F.collect_set("block").alias("todo"))
    joined = rows.join(per, "rk", "left").select("rk", "text", "rest", "todo")
    rest_type = T.StructField("rest", rows.schema["rest"].dataType)  # null in the rows that carry blocks alone
    out_type = T._parse_datatype_string(_OUT).fields
    half_type = T.StructType([T.StructField("rk", T.LongType()), rest_type, *out_type, *T._parse_datatype_string(f"z binary, blocks array<{_BLOCK}>").fields])
    half = scratch.write(joined.mapInArrow(_half(plan, with_bytes), half_type), "half")
    del listed, per, joined
    scratch.drop()

    open_ = half.filter("z is not null")
    sent = half.filter("blocks is not null").select(F.explode("blocks").alias("b")).select("b.*")
    shape = lambda df: df.select("anchor", "shard", "body", "count", "n", "bytes")
    in_shards = lambda df, n: df.repartition(n, "anchor", "shard").sortWithinPartitions("anchor", "shard", F.col("body").asc_nulls_last())
    judged = scratch.write(in_shards(shape(sent.filter("shards = 1")), parts).mapInArrow(_judged(plan, False), "anchor long, body long, marks binary"), "judged")
    if (tasks := hot.agg(F.sum("shards")).first()[0]) is not None:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)
        warm = scratch.write(shape(sent.filter("shards > 1")), "warm")
        named = scratch.write(in_shards(warm, tasks).mapInArrow(_named(plan), "anchor long, shard int, body long, at int, f1 long, f2 long"), "named")
        several = named.groupBy("f1", "f2", "anchor").agg(F.min("shard").alias("low"), F.max("shard").alias("high"), F.min(F.struct("shard", "body", "at")).alias("r")).filter("low < high")
        # a needle is a block of the first shard that has it, with the places of its windows that the other shard names too
        wanted = named.select("f1", "f2", "anchor", "shard").join(several, ["f1", "f2", "anchor"]).groupBy("anchor", "shard", "r.body").agg(F.collect_list("r.at").alias("ats"))
        bytes_of = warm.select("anchor", "body", "bytes").dropDuplicates(["anchor", "body"])
        none = [F.lit(None).cast(t).alias(k) for k, t in (("body", "long"), ("count", "long"), ("n", "int"))]
        needles = wanted.join(bytes_of, ["anchor", "body"]).select("anchor", "shard", *none, "bytes", "ats")
        both = warm.withColumn("ats", F.lit(None).cast("array<int>")).unionByName(needles)
        judged = judged.unionByName(scratch.write(in_shards(both, tasks).mapInArrow(_judged(plan, True), "anchor long, body long, marks binary"), "hot-judged"))
    marks = some.join(judged, ["anchor", "body"]).groupBy("rk").agg(F.collect_set(F.struct("a", "marks")).alias("marks"))
    late = open_.select("rk", "rest", "z").join(marks, "rk", "left").select("rest", "z", "marks").mapInArrow(_rest(plan, with_bytes), T.StructType([rest_type, *out_type]))
    return half.filter("n_bytes is not null").select("rest", *(f.name for f in out_type)).unionByName(late)
