"""Token streams: (shard, doc_id, pos, tok), one row per token; documents never run into each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlake.functions.storage import written


def stream_of(df: DataFrame, doc: str, order: list[str], tok: Column, shards: int = 1, bucket: Column | None = None) -> DataFrame:
    """One row per token from rows that are tokens already, in their order.

    bucket: a column that never falls as rows advance in their order, such as the day of a time. A document's
    places are then counted within buckets and over the buckets' sizes, so that a document of any length is
    dealt over tasks; without it a document is numbered in one task.
    """
    rows = df.select(F.col(doc).alias("doc_id"), tok.alias("tok"), F.struct(*order).alias("at"), (F.lit(0) if bucket is None else bucket).alias("bucket"))
    pos = F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy("at")) - 1
    out = rows.withColumn("pos", pos)
    if bucket is not None:
        sizes = rows.groupBy("doc_id", "bucket").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("bucket")) - F.col("n")
        base = sizes.select(F.col("doc_id").alias("d"), F.col("bucket").alias("b"), before.alias("base"))
        both = out.join(base, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("bucket").eqNullSafe(F.col("b")))
        out = both.withColumn("pos", (F.col("base") + F.col("pos")).cast("int"))
    return out.select(F.pmod(F.col("doc_id"), F.lit(shards)).alias("shard"), "doc_id", "pos", "tok")


def words(df: DataFrame, shards: int = 1, first: int | None = None) -> DataFrame:
    """Words of text between white space, empty ones left out; only the first few of each text, which is not split further, if asked."""
    trimmed = F.btrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    split = F.split(trimmed, r"\s+") if first is None else F.slice(F.split(trimmed, r"\s+", first + 1), 1, first)
    rows = df.select(F.pmod(F.col("doc_id"), F.lit(shards)).alias("shard"), "doc_id", F.posexplode(split).alias("pos", "tok"))
    return rows.filter("tok != ''")  # a text without words is one empty piece


def flatten(df: DataFrame, separator) -> DataFrame:
    """(shard, doc_id, pos, tok) of rows (shard, doc_id, tokens), with the separator after each document."""
    return df.select("shard", "doc_id", F.posexplode(F.concat("tokens", F.array(F.lit(separator)))).alias("pos", "tok"))


def split_flat(df: DataFrame, separator, keep_tail: bool = False, width: int = 65536) -> DataFrame:
    """(shard, doc, pos, tok) of flat rows (shard, at, tok): documents are what stands before separators.

    Tokens after a shard's last separator belong to no document and go, unless keep_tail. Separators are
    counted on two levels, within ranges of `width` places and over the ranges' totals, so that a shard
    of any length is dealt over tasks.
    """
    sep = (F.col("tok") == F.lit(separator)).cast("long")
    part = df.select("shard", "at", "tok", sep.alias("sep"), F.floor(F.col("at") / width).alias("part"))
    totals = part.groupBy("shard", "part").agg(F.sum("sep").alias("seps"))
    by = Window.partitionBy("shard")
    base = totals.select("shard", "part", (F.sum("seps").over(by.orderBy("part")) - F.col("seps")).alias("base"), F.sum("seps").over(by).alias("docs"))
    own = F.sum("sep").over(Window.partitionBy("shard", "part").orderBy("at")) - F.col("sep")
    out = part.withColumn("own", own).join(base, ["shard", "part"]).withColumn("doc", F.col("base") + F.col("own"))
    out = out.filter("sep = 0" if keep_tail else "sep = 0 and doc < docs")
    pos = F.row_number().over(Window.partitionBy("shard", "doc").orderBy("at")) - 1
    return out.select("shard", "doc", pos.alias("pos"), "tok")


def offsets(sizes: DataFrame, width: int = 4096, by: list[str] | None = None) -> DataFrame:
    """(*by, doc_id, offset) of sizes(*by, doc_id, n): where each document begins when a separator follows each.

    Three levels: sums within ranges of `width` ids, within ranges of `width` such ranges, and over those, of
    which there are few.
    """
    by = by or []
    part = sizes.withColumn("part", F.floor(F.col("doc_id") / width))
    totals = part.groupBy(*by, "part").agg(F.sum(F.col("n") + 1).alias("total")).withColumn("top", F.floor(F.col("part") / width))
    tops = totals.groupBy(*by, "top").agg(F.sum("total").alias("sum"))
    first = tops.select(*by, "top", (F.sum("sum").over(Window.partitionBy(*by).orderBy("top")) - F.col("sum")).alias("first"))
    inner = (F.sum("total").over(Window.partitionBy(*by, "top").orderBy("part")) - F.col("total")).alias("inner")
    base = totals.select(*by, "part", "top", inner).join(first, [*by, "top"]).select(*by, "part", (F.col("first") + F.col("inner")).alias("base"))
    own = F.sum(F.col("n") + 1).over(Window.partitionBy(*by, "part").orderBy("doc_id")) - F.col("n") - 1
    return part.withColumn("own", own).join(base, [*by, "part"]).select(*by, "doc_id", (F.col("base") + F.col("own")).alias("offset"))


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows before, in some order of columns without ties.

    Rows are dealt over tasks in ranges and written, so that the sums of the ranges, one number each, are of the same ranges.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    base = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_base"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*order)) - F.col(value)
    out = ranged.withColumn("_own", own).join(F.broadcast(base), "_range")  # as many rows as there are tasks
    return out.withColumn(name, F.col("_base") + F.col("_own")).drop("_range", "_base", "_own")


def flat_places(df: DataFrame) -> DataFrame:
    """(shard, at, tok) of (shard, doc_id, pos, tok): the place of each token in its shard's flat stream, documents by id."""
    sizes = df.groupBy("shard", "doc_id").agg((F.count("*") - 1).alias("n"))
    return df.join(offsets(sizes, by=["shard"]), ["shard", "doc_id"]).select("shard", (F.col("offset") + F.col("pos")).alias("at"), "tok")


def fixed_offsets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, offset) where all documents have n tokens and a separator and ids are dense."""
    return docs.select("doc_id", (F.col("doc_id") * (n + 1)).alias("offset"))


def range_shard(idx: Column, n: int, shards: int) -> Column:
    """Ranges of n div shards rows, the last one longer."""
    return F.least(F.floor(idx / max(1, n // shards)), F.lit(shards - 1)).cast("long")


def distribution(tokens: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, tok, cnt, prob): token counts and shares; shares come from a join with per-group totals, not from one task.

    The counts are a written table, so tokens are made and counted once.
    """
    by = by or []
    counts = written(tokens.groupBy(*by, "tok").agg(F.count("*").alias("cnt")), "token-counts")
    totals = counts.groupBy(*by).agg(F.sum("cnt").alias("total"))
    joined = counts.join(totals, by) if by else counts.withColumn("total", totals.select("total").scalar())
    return joined.select(*by, "tok", "cnt", (F.col("cnt") / F.col("total")).alias("prob"))


def first_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.filter("pos = 0")


def class_distribution(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """(label, tok, cnt, prob) for each of classes(label) from tokens(label, tok); a class without tokens has the distribution of all."""
    own = distribution(tokens, ["label"])
    absent = classes.select("label").distinct().join(own.select("label").distinct(), "label", "left_anti")
    every = distribution(tokens)
    # one copy of the whole distribution for each absent class: that is what is asked for
    lent = absent.withColumn("_all", F.lit(0)).join(every.withColumn("_all", F.lit(0)), "_all").select("label", "tok", "cnt", "prob")
    asked = own.join(classes.select("label").distinct(), "label", "left_semi")
    return asked.unionByName(lent)


def fit_length(tokens: Column, n: int, pad) -> Column:
    """The first n tokens of an array; a shorter one is filled up with pad."""
    return F.concat(F.slice(tokens, 1, n), F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(tokens), F.lit(0))))


def merge_shards(spark, paths: list[str], out: str, order: str, delete: bool = False) -> DataFrame:
    """The rows of several Parquet shards as one table written in the order of a column; the shards are deleted if asked.

    Shards go only after the merged table is there, so a lost run can be repeated.
    """
    union_shards(*[spark.read.parquet(p) for p in paths]).repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").parquet(out)
    if delete:
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.parquet(out)


def union_shards(*shards: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a shard lacks are null."""
    out, *rest = shards
    for x in rest:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def as_u16(tok: Column) -> Column:
    """The value kept by 16 bits."""
    return tok.bitwiseAND(F.lit(65535))
