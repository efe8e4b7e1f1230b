"""Near-duplicate classes: fast similarity sketches, banding, exact verification, components.

Sketch. A set is placed into t bins in rounds: in round r every element falls into one hashed bin
with value (r, hash); a bin keeps its least value. After t rounds, round t+j puts every element
into bin j, so each coordinate is filled whatever the set's size, and rounds stop as soon as all
bins are full. Equal coordinates of two sketches estimate the Jaccard similarity with the
concentration of t-sample min-wise hashing, at O(t log t + n) hash evaluations.

Links. Documents with equal shingle sets form one class, taken as one node. The sketch's
coordinates are cut into bands; nodes with an equal band are candidates. A bucket is not expanded
into all its pairs: first each node is verified against the bucket's least node; then only buckets
whose nodes are still in different components are looked at again. A pair inside one component
cannot change the result, so no link that a bucket holds is lost. Small such buckets give their
pairs across components. In a larger one the nodes outside its largest component are dealt out in
blocks of about `block` nodes, and so are those inside; a block of the former meets every block, those
of the latter do not meet each other, so a bucket that the stars have linked but for a few nodes costs
what these few cost. Where two blocks meet, the intersections are products of an incidence matrix;
only links that join components leave it. With the defaults a pair at similarity 0.75 shares no
band with a probability of 4e-6.

Defined results: texts are compared as lower-cased (A-Z) words; fewer words than a shingle form
one shingle; a text without words (null too) is linked with nothing; a row with a null doc_id is
linked with nothing, keeps a null component and is kept; rows that repeat a doc_id are one node,
and each such row is returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.arrays import SEGMENT, U64, Words, grams, mix, random_table, texts
from tokenlake.llm.components import components
from tokenlake.llm.store import Scratch, text_batches

_LOW = U64((1 << 40) - 1)


@dataclass(frozen=True)
class Plan:
    """shingle: words per shingle; percent: least Jaccard similarity in percent; bands of rows coordinates each;
    small: nodes of a bucket that is paired out; block: nodes of a block of larger ones."""

    shingle: int = 5
    percent: int = 75
    bands: int = 64
    rows: int = 6
    small: int = 8
    block: int = 512


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of a non-empty set of 64-bit values, none left unfilled."""
    seeds = random_table(2 * t, 99)
    out = np.full(t, np.iinfo(U64).max, U64)
    done, n = 0, len(elements)
    step = max(1, math.ceil(t * (math.log(t) + 3) / n))
    while done < t:
        rounds = np.arange(done, min(t, done + step))
        for part in np.array_split(rounds, min(len(rounds), max(1, len(rounds) * n >> 20))):
            for some in range(0, n, SEGMENT):
                h = mix(elements[None, some : some + SEGMENT] ^ seeds[part][:, None])
                bins = ((h >> U64(40)) * U64(t)) >> U64(24)
                np.minimum.at(out, bins.ravel().astype(np.int64), ((part.astype(U64) << U64(40))[:, None] | (h & _LOW)).ravel())
        done += len(rounds)
        empty = np.flatnonzero(out == np.iinfo(U64).max)
        if not len(empty):
            return out
        step = max(step, 8)
    for j in empty:
        out[j] = (U64(t + j) << U64(40)) | (mix(elements ^ seeds[t + j]) & _LOW).min()
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    words = Words(data, offsets, lower=True)
    windows = grams(words.hash, k)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(windows[a : b - k + 1]))
        elif b > a:
            out.append(mix(grams(words.hash[a:b], b - a) ^ U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def _signatures(plan: Plan):
    names = ["doc_id", "n_shingles", "s1", "s2", "bands"]
    t = plan.bands * plan.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_seed = random_table(plan.bands, 7)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in texts(batch, "text"):
                sets = shingles(data, offsets, plan.shingle)
                keys = np.zeros((len(sets), plan.bands), U64)
                known: dict[tuple[int, int, int], np.ndarray] = {}
                s1, s2 = np.zeros(len(sets), U64), np.zeros(len(sets), U64)
                for i, x in enumerate(sets):
                    if len(x):
                        s1[i], s2[i] = mix(x).sum(), mix(x ^ U64(0x5851F42D4C957F2D)).sum()
                        same = (int(s1[i]), int(s2[i]), len(x))
                        if same not in known:
                            known[same] = mix(grams_of_rows(sketch(x, t).reshape(plan.bands, plan.rows)) ^ band_seed)
                        keys[i] = known[same]
                bands = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *([plan.bands] * len(sets))]), pa.int32()), pa.array(keys.reshape(-1).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), bands], names
                )

    return run


def grams_of_rows(matrix: np.ndarray) -> np.ndarray:
    """One hash for each row."""
    out = np.zeros(len(matrix), U64)
    for column in matrix.T:
        out = mix(out * U64(3) + column)
    return out


def _packed_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts of rows sorted by document; rows that repeat a document's text are left out."""
    press = zstandard.ZstdCompressor(level=1)
    last, seen = None, set()
    for batch in batches:
        docs, packed = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            if doc != last:
                last, seen = doc, set()
            if (digest := hashlib.md5(raw).digest()) not in seen:
                seen.add(digest)
                docs.append(doc)
                packed.append(press.compress(raw))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(packed, pa.binary())], ["doc", "z"])


def _verified(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        last: dict[bytes, np.ndarray] = {}

        def of(z: bytes) -> np.ndarray:
            if (got := last.get(z)) is None:
                raw = np.frombuffer(open_.decompress(z), np.uint8)
                if len(last) >= 64:
                    last.clear()
                got = last[z] = shingles(raw, np.array([0, len(raw)]), plan.shingle)[0]
            return got

        for batch in batches:
            u, v = batch.column(0), batch.column(1)
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = of(a.as_py()), of(b.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= plan.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def linked_pairs(sets: list[np.ndarray], parts: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs of places whose sets are similar enough and whose parts differ; one pair for each two parts that they join."""
    size = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = count[column] > 1  # what only one set holds is in no intersection
    row, (_, column) = row[some], np.unique(column[some], return_inverse=True)
    both = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    label = np.array(parts)
    good = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1) & (label[:, None] != label[None, :]) & (both > 0)
    out, head = [], {p: p for p in parts}

    def top(p: int) -> int:
        while head[p] != p:
            head[p] = p = head[head[p]]
        return p

    for i, j in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
        if (p := top(parts[i])) != (q := top(parts[j])):
            head[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def _blocked(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()

        def links(group: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            raw = [open_.decompress(z) for _, _, z in group]
            sets = shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), plan.shingle)
            found = linked_pairs(sets, [p for _, p, _ in group], plan.percent)
            ends = [[group[x[k]][0] for x in found] for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["u", "v"])

        group, last = [], None
        for batch in batches:
            for key, node, part, z in zip(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True), *(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True):
                if key != last:
                    if len({p for _, p, _ in group}) > 1:
                        yield links(group)
                    group, last = [], key
                group.append((node, part, z))
        if len({p for _, p, _ in group}) > 1:
            yield links(group)

    return run


def _verify(pairs: DataFrame, z: DataFrame, plan: Plan, scratch: Scratch, name: str) -> DataFrame:
    """The pairs(x, y) whose full shingle sets are similar enough, as edges(u, v)."""
    left, right = z.withColumnsRenamed({"doc": "x", "z": "zx"}), z.withColumnsRenamed({"doc": "y", "z": "zy"})
    both = pairs.hint("merge").join(left, "x").hint("merge").join(right, "y").select("x", "y", "zx", "zy")
    return scratch.write(both.mapInArrow(_verified(plan), "u long, v long"), f"{name}-edges")


def in_blocks(many: DataFrame, block: int) -> DataFrame:
    """many(band, node, part, ...) with (kind, i, j): groups of about two blocks in which all nodes of a bucket meet that are in different
    parts. Nodes of the largest part meet all others, but not each other."""
    largest = many.groupBy("band", "part").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("all"))
    in_blocks = lambda n: F.ceil(n / block).cast("int")
    dealt = many.join(largest.select("band", F.col("top.part").alias("major"), in_blocks(F.col("all") - F.col("top.n")).alias("minors"), in_blocks(F.col("top.n")).alias("majors")), "band")
    inside = F.col("part") == F.col("major")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", "band"), F.when(inside, F.col("majors")).otherwise(F.col("minors"))).cast("int"))
    meet = lambda f, kind, i, j: F.transform(F.sequence(F.lit(0), F.col(f) - 1), lambda k: F.struct(F.lit(kind).alias("kind"), i(k).alias("i"), j(k).alias("j")))
    own = F.col("own")
    outside = F.concat(meet("minors", 0, lambda k: F.least(own, k), lambda k: F.greatest(own, k)), meet("majors", 1, lambda k: own, lambda k: k))
    dealt = dealt.withColumn("meet", F.when(inside, meet("minors", 1, lambda k: k, lambda k: own)).otherwise(outside))
    return dealt.select("*", F.explode("meet").alias("m")).select(*many.columns, "m.kind", "m.i", "m.j")


def links_of_buckets(members: DataFrame, z: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """edges(u, v) that join all nodes that links within buckets connect, not all links.

    members(band, node, n, least, size): the nodes of each bucket, their sets' sizes, the bucket's least node and size;
    z(doc, z): packed texts.
    """
    # a set can only be similar enough to one at least percent / 100 of its size
    close = lambda a, b: (100 * F.least(a, b) >= plan.percent * F.greatest(a, b))
    least = members.filter("node = least").select("band", F.col("n").alias("least_n"))
    stars = members.filter("node != least").join(least, "band").filter(close(F.col("n"), F.col("least_n"))).select(F.col("least").alias("x"), F.col("node").alias("y"))
    stars = scratch.write(stars.distinct(), "stars")
    first = _verify(stars, z, plan, scratch, "star")
    parts = scratch.write(components(first, scratch, "first"), "parts")

    placed = scratch.write(members.join(parts, members.node == parts.node, "left").select("band", members.node, "n", "size", F.coalesce("component", members.node).alias("part")), "placed")
    split = scratch.write(placed.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("band"), "split")
    open_ = scratch.write(placed.join(split, "band"), "open")
    few, many = open_.filter(F.col("size") <= plan.small), open_.filter(F.col("size") > plan.small)
    a, b = few.select("band", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("part").alias("px")), few.select("band", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("part").alias("py"))
    across = a.join(b, "band").filter((F.col("x") < F.col("y")) & (F.col("px") != F.col("py")) & close(F.col("nx"), F.col("ny"))).select("x", "y").distinct()
    across = scratch.write(across.join(stars, ["x", "y"], "left_anti"), "across")
    second = _verify(across, z, plan, scratch, "across")

    dealt = scratch.write(in_blocks(many, plan.block).select("band", "kind", "i", "j", "node", "part"), "dealt")
    groups = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt.count() // (2 * plan.block))
    dealt = dealt.join(z.withColumnRenamed("doc", "node"), "node").select("band", "kind", "i", "j", "node", "part", "z")
    third = scratch.write(dealt.repartition(groups, "band", "kind", "i", "j").sortWithinPartitions("band", "kind", "i", "j", "node").mapInArrow(_blocked(plan), "u long, v long"), "blocked")
    return first.union(second).union(third)


def links_by_id(linked: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(u, v) between an id that several rows(doc_id, s1, s2, n_shingles) have and the nodes(s1, s2, n, node) of their sets."""
    several = linked.groupBy("doc_id").agg(F.count("*").alias("rows")).filter(F.col("rows") > 1).select("doc_id")
    sets = linked.select("doc_id", "s1", "s2", "n_shingles").join(several, "doc_id", "left_semi").distinct()
    of = nodes.select("s1", "s2", F.col("n").alias("n_shingles"), "node")
    return sets.join(of, ["s1", "s2", "n_shingles"]).filter("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.write(docs.mapInArrow(_signatures(plan), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "signed")
    linked = signed.filter("doc_id is not null and n_shingles > 0")
    classes = linked.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("r"))
    nodes = scratch.write(classes.select("s1", "s2", F.col("n_shingles").alias("n"), F.col("r.doc_id").alias("node"), F.col("r.bands").alias("bands")), "nodes")
    # joins of what grows with the corpus are merge joins at every size; shared bands are a table of their own, so that frequent ones can be split
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = scratch.write(banded.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("size")).filter("size > 1"), "bands")
    members = scratch.write(banded.hint("merge").join(shared, "band"), "members")
    needed = members.select(F.col("node").alias("doc_id")).distinct()
    z = scratch.write(docs.hint("merge").join(needed, "doc_id", "left_semi").mapInArrow(_packed_text, "doc long, z binary"), "z")
    scratch.drop("bands")

    whole = scratch.write(components(links_of_buckets(members, z, plan, scratch).union(links_by_id(linked, nodes)), scratch, "whole"), "whole")

    table = nodes.join(whole, "node", "left").select("s1", "s2", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component"))
    table = scratch.write(table, "table")
    rows = signed.drop("bands").hint("merge").join(table, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(component)
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
