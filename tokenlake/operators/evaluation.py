"""Memorisation, reconstruction error and progress."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenlake.functions.batches import PIECE, pieces, stacked


def memorised(generated: DataFrame, corpus: DataFrame, on: str) -> DataFrame:
    """Rows of generated whose whole sequence stands in corpus; sequences are compared by SHA-256 digest."""
    key = F.sha2(F.col(on).cast("string"), 256)
    return generated.withColumn("key", key).join(corpus.select(key.alias("key")).distinct(), "key", "left_semi").drop("key")


def novel(generated: DataFrame, corpus: DataFrame, on: str) -> DataFrame:
    """Rows of generated whose sequence stands nowhere in corpus."""
    key = F.sha2(F.col(on).cast("string"), 256)
    return generated.withColumn("key", key).join(corpus.select(key.alias("key")).distinct(), "key", "left_anti").drop("key")


def mse(a: Column, b: Column) -> Column:
    return F.avg(F.pow(a - b, F.lit(2.0)))


def psnr(mean_square: Column) -> Column:
    return 10 * F.log10(255.0 * 255.0 / (mean_square + 1e-10))


def image_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(img_id, mse) of two tables of images(img_id, data) of the same sizes, joined by id; whole images meet, not pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            error = [float(((np.frombuffer(x, np.uint8).astype(float) - np.frombuffer(y, np.uint8)) ** 2).mean()) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(error, pa.float64())], ["img_id", "mse"])

    # images are large and their ids are not: by the size of the ids' table Spark would send the images to every task
    both = a.select("img_id", F.col("data").alias("x")).hint("merge").join(b.select("img_id", F.col("data").alias("y")), "img_id")
    return both.mapInArrow(run, "img_id long, mse double")


def round_trip_errors(images: DataFrame, tokenizer, piece: int = PIECE) -> DataFrame:
    """(img_id, mse) of images(img_id, height, width, data) beside what the tokenizer decodes from their tokens, in one pass without a join.

    Images of another size than the tokenizer's have none to be compared with and are left out, as broken ones are.
    """
    size = tokenizer.size
    each = max(size**2 * 3, tokenizer.tokens_per_image * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3, each, piece):
            sides = pc.and_(pc.equal(batch.column(1), size), pc.equal(batch.column(2), size))
            kept = batch.filter(pc.and_(sides, pc.equal(pc.binary_length(batch.column(3)), size * size * 3)))
            if kept.num_rows:
                x = stacked(kept, 3, size, size, 3)
                y = tokenizer.decode(np.asarray(tokenizer.encode(x)).astype(np.int32).astype(np.int64))
                error = ((x.astype(float) - y) ** 2).reshape(len(x), -1).mean(1)
                yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(error, pa.float64())], ["img_id", "mse"])

    return images.select(F.col("img_id").cast("long").alias("img_id"), "height", "width", "data").mapInArrow(run, "img_id long, mse double")


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """A struct of rate (units a second), percent done and eta (seconds left; null before anything is done)."""
    rate = F.when(seconds > 0, done / seconds)
    return F.struct(rate.alias("rate"), F.when(total > 0, 100.0 * done / total).alias("percent"), F.when(rate > 0, (total - done) / rate).alias("eta"))


def speed(tokenizer, images: np.ndarray, repeat: int = 3) -> float:
    """Images a second that a tokenizer codes on one core, the best of some runs."""
    best = float("inf")
    for _ in range(repeat):
        began = time.perf_counter()
        tokenizer.encode(images)
        best = min(best, time.perf_counter() - began)
    return len(images) / best


def shares(stages: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """stages with `percent`, the share of a stage's seconds in those of its group."""
    total = stages.groupBy(*by).agg(F.sum(seconds).alias("_total"))
    joined = stages.join(total, by) if by else stages.withColumn("_total", total.select("_total").scalar())
    return joined.withColumn("percent", 100.0 * F.col(seconds) / F.col("_total")).drop("_total")
