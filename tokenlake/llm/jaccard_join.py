"""N-gram Jaccard join: documents linked when their shingle sets are similar enough, found exactly.

A size-aware join: equal sets are one node, and a boundary parts nodes into light ones with small
sets and heavy ones with large sets.

Light with light. Two sets of a and b >= a elements are similar enough exactly if they have a subset
of c = ceil(percent (a + b) / (100 + percent)) elements in common. For each pair of sizes a light
node enumerates its subsets of that fixed size, by leaving out few elements, as 128-bit hashes. Who
shares a subset with a node of the smaller size is linked to it, so a bucket is a star, and no pair
need be listed or verified.

Any with heavy. Elements have a fixed order. A set of n elements and any similar enough have one of
their first n - ceil(percent n / 100) + 1 in common, so these make inverted lists, of heavy nodes and of
the light ones whose size a heavy one's can match. The order puts elements with long lists last: lists
by hash order alone are counted first, elements of more than `frequent` rows go into a bitmap of
bounded size, and lists are made again with those last. Each list is scanned: its nodes against its
least one, then, where nodes are left in different components, against each other, in groups of about two
blocks. A scan sees 64 bytes of each node: the parities of its hashed elements in 512 places. They
differ in no more places than the sets in elements, so most pairs are out by a popcount; whole sets of the others are
compared. The first scan passes on the closest pair of each two components only; where it left others out
and the components are still two, a second one passes on all.

Boundary. The cost of light nodes of a size is the number of their subsets. That of heavy ones is what
scanning their lists takes: the lengths of all lists in which they stand, as counted, each time
`scan`. The boundary between 1 and the largest size with at most `subsets` of them is the one of least total cost.

Every decision rests on whole sets. Shingles are equal when their 64-bit hashes are; subsets by 128 bits.

Defined results: texts are compared as lower-cased (A-Z) words; fewer words than a shingle are one
shingle; a text without words (null too) is linked with nothing, nor is a row with a null doc_id, whose
component is null; rows that repeat a doc_id are one node, and each such row is returned. An empty
table gives an empty result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tokenlake.llm import near_dedup
from tokenlake.llm.arrays import BASE, U64, mix, ranges, texts
from tokenlake.llm.components import components
from tokenlake.llm.hash_filter import Filter
from tokenlake.llm.near_dedup import links_by_id, shingles
from tokenlake.llm.store import Scratch, text_batches

#: 64-bit words of the parities of a set.
WIDE = 8
_SECOND = U64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Plan:
    """shingle: words per shingle; percent: least Jaccard similarity in percent; frequent: rows of a list whose element is put last;
    bits: most bits of the bitmap of such elements, as a power of two; subsets: most subsets of a light node; scan: cost of a place of a
    list that is scanned, in subsets; block: nodes of a block of a list."""

    shingle: int = 3
    percent: int = 90
    frequent: int = 4
    bits: int = 27
    subsets: int = 2048
    scan: float = 2.0
    block: int = 512

    def common(self, a: int, b: int) -> int:
        """Elements that sets of a and b elements must share."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def least(self, n: int) -> int:
        """Elements that a set of n shares with any that is similar enough, and the size of the smallest such set."""
        return -(-self.percent * n // 100)

    def sizes(self, n: int) -> list[tuple[int, int, int]]:
        """(a, b, c) for the pairs of sizes of which one is n, c being less than the larger: different sets can link."""
        with_ = ((min(n, m), max(n, m)) for m in range(self.least(n), n * 100 // self.percent + 1))
        return [(a, b, c) for a, b in with_ if (c := self.common(a, b)) <= a and c < b]

    def enumerated(self, n: int) -> int:
        return sum(math.comb(n, c) for _, _, c in self.sizes(n))

    def largest_light(self) -> int:
        """Largest size up to which all sets have few enough subsets."""
        n = 1
        while n < 256 and self.enumerated(n + 1) <= self.subsets:
            n += 1
        return n


def _ordered(x: np.ndarray, frequent) -> np.ndarray:
    """The elements of a sorted set with the frequent ones last."""
    late = frequent(mix(x))
    return np.concatenate([x[~late], x[late]]) if late.any() else x


def _nodes(plan: Plan, light: int, frequent):
    """Sizes, identity and first elements of sets, the parities, and the whole set where it may be light. Only first elements with frequent=None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in texts(batch, "text"):
                sets = shingles(data, offsets, plan.shingle)
                size = np.array([len(x) for x in sets], np.int64)
                chosen = [x if frequent is None else _ordered(x, frequent.value) for x in sets]
                first = [x[: len(x) - plan.least(len(x)) + 1] for x in chosen]
                s1 = np.array([mix(x).sum(dtype=U64) for x in sets], U64)
                s2 = np.array([mix(x ^ _SECOND).sum(dtype=U64) for x in sets], U64)
                columns = [ids.slice(lo, hi - lo), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _lists(first)]
                if frequent is not None:
                    parities = np.zeros((len(sets), WIDE), U64)
                    row, place = np.repeat(np.arange(len(sets)), size), mix(np.concatenate([np.zeros(0, U64), *sets]) ^ U64(BASE)) >> U64(55)
                    np.bitwise_xor.at(parities, (row, (place >> U64(6)).astype(np.int64)), U64(1) << (place & U64(63)))
                    columns += [pa.array(x.view(np.int64)) for x in np.ascontiguousarray(parities.T)]
                    columns.append(_lists([x if 0 < len(x) <= light else x[:0] for x in sets]))
                yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])

    return run


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate([np.zeros(0, U64), *sets]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(values))


@cache
def _left_out(n: int, d: int) -> np.ndarray:
    """All choices of d of n elements."""
    return np.array(list(combinations(range(n), d)), np.int64).reshape(math.comb(n, d), d)


def subsets(plan: Plan, elements: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, k1, k2): the hashes of the subsets with which a set can link, by pair of sizes."""
    n = len(elements)
    h1, h2 = mix(elements ^ U64(BASE)), mix(elements ^ _SECOND)
    for a, b, c in plan.sizes(n):
        out = _left_out(n, n - c)
        yield a, b, h1.sum(dtype=U64) - h1[out].sum(axis=1, dtype=U64), h2.sum(dtype=U64) - h2[out].sum(axis=1, dtype=U64)


def _enumerated(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                node, rows = [], []
                part = batch.slice(k, 64)
                for doc, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    for a, b, k1, k2 in subsets(plan, np.array(x.as_py(), np.int64).view(U64)):
                        rows.append((np.full(len(k1), a), np.full(len(k1), b), k1.view(np.int64), k2.view(np.int64), np.full(len(k1), len(x))))
                        node.append(np.full(len(k1), doc))
                if rows:
                    columns = [pa.array(np.concatenate(x)) for x in (*zip(*rows, strict=True), node)]
                    columns[:2] = [x.cast(pa.int32()) for x in columns[:2]]
                    columns[4] = columns[4].cast(pa.int32())
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "k1", "k2", "n", "node"])

    return run


def light_links(light: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """edges(u, v) that connect what links of light nodes(node, tokens) connect."""
    keys = scratch.write(light.mapInArrow(_enumerated(plan), "a int, b int, k1 long, k2 long, n int, node long"), "subsets")
    by = ["a", "b", "k1", "k2"]
    heads = keys.groupBy(*by).agg(F.min(F.when(F.col("n") == F.col("a"), F.col("node"))).alias("head"), F.count("*").alias("size")).filter("head is not null and size > 1")
    return keys.join(heads, by).filter("node != head").select(F.col("head").alias("u"), F.col("node").alias("v")).distinct()


def boundary(costs: list[Row], plan: Plan) -> int:
    """The size below which sets are light, from (n, nodes, places of lists to scan) of the sizes that may be."""
    limit = plan.largest_light()
    known = {r["n"]: (r["nodes"] * plan.enumerated(r["n"]), r["places"] * plan.scan) for r in costs}
    total = sum(scan for _, scan in known.values())
    best = 1, total
    for n in range(1, limit + 1):
        light, scan = known.get(n, (0, 0.0))
        total += light - scan
        if total <= best[1]:
            best = n + 1, total
    return best[0]


def _lists_of(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", "n", F.explode("first").alias("band"))


def _most_apart(plan: Plan, both):
    """In how many elements sets of so many elements together may differ."""
    return both - 2 * -(-plan.percent * both // (100 + plan.percent))


def _scanned(plan: Plan, closest: bool, cells: int = 1 << 17):
    """(band, x, y, more) of rows (band, kind, i, j, node, part, n, parities) sorted by the first four: pairs of a group that may be linked
    and are in different parts. closest: one for each two parts, and whether the group had more."""

    def scan(columns: list[np.ndarray], begin: np.ndarray) -> pa.RecordBatch:
        """Of whole groups, which begin at the given rows; all are taken at once, `cells` pairs at a time."""
        node, part, n = columns[4:7]
        bits = np.stack(columns[7:], axis=1).view(U64)
        size = np.diff(np.append(begin, len(node)))
        behind = np.repeat(begin + size, size) - np.arange(len(node)) - 1  # rows of the group after each
        total, found, a = np.cumsum(behind), [], 0
        while a < len(node):
            b = max(a + 1, int(np.searchsorted(total, total[a] - behind[a] + cells, "right")))
            i, j = np.repeat(np.arange(a, b), behind[a:b]), ranges(np.arange(a, b) + 1, behind[a:b])
            most = _most_apart(plan, n[i] + n[j])
            some = np.flatnonzero((part[i] != part[j]) & (np.abs(n[i] - n[j]) <= most))
            i, j, most = i[some], j[some], most[some]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            good = np.flatnonzero(apart <= most)
            found.append((i[good], j[good], apart[good]))
            a = b
        i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True))
        group, low, high = np.searchsorted(begin, i, "right") - 1, np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
        order = np.lexsort((apart, high, low, group))
        i, j, group, low, high = (x[order] for x in (i, j, group, low, high))
        first = np.append(True, (group[1:] != group[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(order)]
        more = np.bincount(group[~first], minlength=len(begin)) > 0
        kept = np.flatnonzero(first) if closest else np.arange(len(order))
        i, j, group = i[kept], j[kept], group[kept]
        out = [columns[0][i], np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), more[group]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["band", "x", "y", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy() for c in batch.columns])
            if any(held[0][k][0] != held[-1][k][-1] for k in range(4)):  # at least one group is whole
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                new = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
                begin = np.append(0, np.flatnonzero(new) + 1)
                yield scan([c[: begin[-1]] for c in columns], begin[:-1])
                held = [[c[begin[-1] :] for c in columns]]
        if held:
            yield scan([np.concatenate(x) for x in zip(*held, strict=True)], np.zeros(1, np.int64))

    return run


def _packed(wanted):
    """(doc, z) of rows (key, doc_id, text) whose key passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = np.flatnonzero(wanted.value(batch.column(0).to_numpy().view(U64)))
            z = [press.compress((batch.column(2)[int(k)].as_py() or "").encode()) for k in at]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at)), pa.array(z, pa.binary())], ["doc", "z"])

    return run


def heavy_links(members: DataFrame, docs: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """edges(u, v) that connect what links within lists connect: members(band, node, n, least, p0, ...), a written table."""
    rules = near_dedup.Plan(shingle=plan.shingle, percent=plan.percent)
    parities = [f"p{k}" for k in range(WIDE)]
    spark = members.sparkSession

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of a written table of pairs(x, y), those whose whole sets are similar enough."""
        ids = pairs.select(F.col("x").alias("doc")).union(pairs.select("y")).distinct().select(F.xxhash64("doc").alias("key"))
        wanted = spark.sparkContext.broadcast(Filter.of(ids, plan.bits))
        keyed = docs.filter("doc_id is not null").select(F.xxhash64("doc_id").alias("key"), "doc_id", "text")
        z = scratch.write(keyed.mapInArrow(_packed(wanted), "doc long, z binary").distinct(), f"{name}-z")
        wanted.destroy()
        edges = near_dedup._verify(pairs, z, rules, scratch, name)
        scratch.drop(f"{name}-z")
        return edges

    def still_open(table: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        """Rows, with their nodes' components as part, of the lists whose nodes are in several."""
        parts = scratch.write(components(edges, scratch, name), f"{name}-parts")
        placed = table.drop("part").join(parts, "node", "left").select(*table.drop("part").columns, F.coalesce("component", "node").alias("part"))
        placed = scratch.write(placed, f"{name}-placed")
        placed = placed.drop("size")
        split = placed.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("size")).filter("low < high").select("band", "size")
        rows = scratch.write(placed.hint("merge").join(split, "band"), f"{name}-open")
        scratch.drop(f"{name}-placed", f"{name}-parts")
        return rows

    def scanned(rows: DataFrame, closest: bool, name: str) -> DataFrame:
        columns = ["band", "kind", "i", "j", "node", "part", "n", *parities]
        whole = rows.filter(F.col("size") <= plan.block).withColumns({k: F.lit(0) for k in ("kind", "i", "j")})
        dealt = whole.select(columns).union(near_dedup.in_blocks(rows.filter(F.col("size") > plan.block), plan.block).select(columns))
        groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // (64 * plan.block))
        dealt = dealt.repartition(groups, "band", "kind", "i", "j").sortWithinPartitions("band", "kind", "i", "j")
        return scratch.write(dealt.mapInArrow(_scanned(plan, closest), "band long, x long, y long, more boolean"), name)

    head = members.filter("node = least").select("band", F.col("n").alias("n0"), *(F.col(p).alias(f"{p}h") for p in parities)).dropDuplicates(["band"])
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}h"))) for p in parities[1:]), F.bit_count(F.col("p0").bitwiseXOR(F.col("p0h"))))
    both = F.col("n") + F.col("n0")
    most = both - 2 * F.ceil(plan.percent * both / (100 + plan.percent))
    stars = members.filter("node != least").hint("merge").join(head, "band").filter((apart <= most) & (F.abs(F.col("n") - F.col("n0")) <= most))
    stars = scratch.write(stars.select(F.col("least").alias("x"), F.col("node").alias("y")).distinct(), "stars")
    first = verified(stars, "star")

    rows = still_open(members.drop("least"), first, "first")
    scratch.drop("members")
    closest = scanned(rows, True, "closest")
    pairs = scratch.write(closest.select("x", "y").distinct().join(stars, ["x", "y"], "left_anti"), "across")
    edges = first.union(verified(pairs, "across"))

    rest = closest.filter("more").select("band").distinct()
    rows = still_open(rows.join(rest, "band", "left_semi"), edges, "second")
    scratch.drop("first-open")
    final = scanned(rows, False, "final").select("x", "y").distinct()
    final = scratch.write(final.join(stars.union(pairs), ["x", "y"], "left_anti"), "others")
    return edges.union(verified(final, "other"))


def jaccard_join(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "jaccard-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    limit = plan.largest_light()

    def sets(frequent, more: str = "") -> DataFrame:
        return docs.mapInArrow(_nodes(plan, limit, frequent), "doc_id long, n_shingles long, s1 long, s2 long, first array<long>" + more)

    some = sets(None).select(F.explode("first").alias("band"))
    often = scratch.write(some.groupBy("band").agg(F.count("*").alias("size")).filter(F.col("size") > plan.frequent).select("band"), "often")
    late = spark.sparkContext.broadcast(Filter.of(often.mapInArrow(_mixed, "key long"), plan.bits))
    scratch.drop("often")
    parities = [f"p{k}" for k in range(WIDE)]
    signed = scratch.write(sets(late, "".join(f", {p} long" for p in parities) + ", tokens array<long>"), "signed")

    linked = signed.filter("doc_id is not null and n_shingles > 0")
    own = F.min(F.struct("doc_id", "first", *parities, "tokens")).alias("r")
    classes = linked.groupBy("s1", "s2", "n_shingles").agg(own)
    nodes = classes.select("s1", "s2", F.col("n_shingles").alias("n"), F.col("r.doc_id").alias("node"), *(f"r.{c}" for c in ("first", *parities, "tokens")))
    nodes = scratch.write(nodes, "nodes")

    shared = scratch.write(_lists_of(nodes).groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("size")).filter("size > 1"), "lists")
    placed = scratch.write(_lists_of(nodes).hint("merge").join(shared, "band"), "placed")
    places = placed.filter(F.col("n") <= limit).groupBy("n").agg(F.sum("size").alias("places"))
    costs = nodes.filter(F.col("n") <= limit).groupBy("n").agg(F.count("*").alias("nodes")).join(places, "n", "left").fillna(0)
    edge = boundary(costs.collect(), plan)
    first = scratch.write(light_links(nodes.filter(F.col("n") < edge).select("node", "tokens"), plan, scratch), "light")
    scratch.drop("lists", "subsets")

    # lists of nodes that can link with a heavy one; least is that of these nodes
    heavy = placed.filter(F.col("n") >= plan.least(edge)).drop("least", "size")
    lists = heavy.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("size"), F.max("n").alias("most")).filter(f"size > 1 and most >= {edge}")
    members = heavy.hint("merge").join(lists.select("band", "least"), "band")
    members = scratch.write(members.hint("merge").join(nodes.select("node", "n", *parities), ["node", "n"]), "members")
    scratch.drop("placed")
    second = heavy_links(members, docs, plan, scratch)
    whole = scratch.write(components(first.union(second).union(links_by_id(linked, nodes)), scratch, "all"), "all")
    late.destroy()

    table = nodes.join(whole, "node", "left").select("s1", "s2", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component"))
    table = scratch.write(table, "table")
    rows = signed.select("doc_id", "n_shingles", "s1", "s2").hint("merge").join(table, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"))


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        band = np.asarray(batch.column(0)).view(U64)
        yield pa.RecordBatch.from_arrays([pa.array(mix(band).view(np.int64))], ["key"])
