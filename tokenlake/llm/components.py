"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation with map-side combining and an equi-join, which adaptive execution
can split where one node has very many edges. The edges of each round are a written table, so no
lineage grows and a lost executor costs one step. Nothing but a count and a checksum reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.store import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), each once with u > v. Large: a node's larger neighbours are tied to its least one; small: the smaller ones."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.filter("v > u") if large else both
    out = tied.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges(u, v); component is the least node that can be reached."""
    now = scratch.write(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0"
    )
    mark = None
    for k in range(1, most_rounds + 1):
        now = scratch.write(_star(_star(now, True), False), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
        new = now.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
