"""Codebook training by Lloyd iterations over a DataFrame of vectors (vec_id, v array<double>).

The codebook has a fixed number of codes and goes to the tasks as a matrix; vectors stay
distributed. An iteration is one pass: assignment in Arrow batches, sums per code inside each
batch, then an aggregate of at most codes x batches rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.functions import images as im
from tokenlake.functions.batches import lists, pieces
from tokenlake.functions.storage import written
from tokenlake.operators.tokenizers import HVQ_SHAPES, VQ_SHAPES, HierarchicalVq, Vq, nearest


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def assign(vectors: DataFrame, codebook: np.ndarray) -> DataFrame:
    """(vec_id, code, distance): the nearest code, the lowest of equals, and its squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1))
                code = nearest(v, codebook)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code), pa.array(((v - codebook[code]) ** 2).sum(1))], ["vec_id", "code", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, code int, distance double")


def sample_vectors(vectors: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, those whose ids have the least digests; a top-n of each task, then of those."""
    return vectors.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))), "vec_id").limit(n)


def blocks(images: DataFrame, block: int, size: int) -> DataFrame:
    """(vec_id, v) of images(img_id, height, width, data): all blocks of each image, stretched to `size` if it has another.

    vec_id is img_id times the blocks of an image, plus the block's place in raster order. Broken images give none.
    """
    per = (size // block) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3, size * size * 3):
            ids, good = [], []
            for i, h, w, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if data is None or not h or not w or len(data) != h * w * 3:
                    continue
                image = np.frombuffer(data, np.uint8).reshape(1, h, w, 3)
                good.append(image if (h, w) == (size, size) else im.resize(image, size, size, "lanczos"))
                ids.append(i)
            if good:
                rows = im.to_blocks(np.concatenate(good), block).reshape(len(good) * per, -1).astype(float)
                where = (np.array(ids)[:, None] * per + np.arange(per)).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), lists(rows)], ["vec_id", "v"])

    return images.select("img_id", "height", "width", "data").mapInArrow(run, "vec_id long, v array<double>")


def initial(vectors: DataFrame, codes: int, seed: int = 0) -> np.ndarray:
    """Distinct vectors of the data, each standing for the rows that equal it by the least id; at most `codes` rows reach the driver."""
    one = vectors.groupBy("v").agg(F.min("vec_id").alias("vec_id"))
    return np.array([r["v"] for r in sample_vectors(one, codes, seed).select("v").collect()], float)


def update(vectors: DataFrame, codebook: np.ndarray, reseed_below: int = 1, seed: int = 0) -> tuple[np.ndarray, float]:
    """(means of the assigned vectors, mean squared distance to the old codes); codes with fewer vectors are drawn anew."""
    size = codebook.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, error = np.zeros_like(codebook), np.zeros(len(codebook)), 0.0
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0))
                code = nearest(v, codebook)
                np.add.at(sums, code, v)
                counts += np.bincount(code, minlength=len(codebook))
                error += ((v - codebook[code]) ** 2).sum()
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(has, pa.int32()), pa.array(counts[has]), pa.array(list(sums[has]), pa.list_(pa.float64())), pa.array(np.where(np.arange(len(has)) == 0, error, 0.0))], ["code", "n", "s", "error"]
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = np.column_stack([batch.column(1).to_numpy(), batch.column(3).to_numpy(), matrix(batch.column(2)) if batch.num_rows else np.zeros((0, size))])
            for code, row in zip(batch.column(0).to_pylist(), rows, strict=True):
                total[code] = total[code] + row if code in total else row
        rows = np.array(list(total.values())).reshape(-1, size + 2)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rows[:, 0]), pa.array(list(rows[:, 2:]), pa.list_(pa.float64())), pa.array(rows[:, 1])], ["code", "n", "s", "error"])

    # sums of one code, an array for each task that saw it, are added in one task
    kinds = "code int, n double, s array<double>, error double"
    total = vectors.select("v").mapInArrow(run, kinds).repartition("code").mapInArrow(added, kinds).toArrow()
    out, counts = codebook.copy(), np.zeros(len(codebook))
    code = total.column("code").to_numpy()
    if len(code):
        counts[code] = total.column("n").to_numpy()
        out[code] = np.stack(total.column("s").to_pylist()) / counts[code][:, None]
    if len(low := np.flatnonzero(counts < reseed_below)):
        out[low] = np.resize(initial(vectors, len(low), seed + 1), (len(low), size))
    return out, float(total.column("error").to_numpy().sum()) / max(counts.sum(), 1)


def fit(vectors: DataFrame, codes: int, iterations: int = 10, seed: int = 0, reseed_below: int = 1) -> np.ndarray:
    """Lloyd's algorithm from distinct data vectors. With reseed_below = 2 codes of a single vector are drawn anew too."""
    codebook = initial(vectors, codes, seed)
    for k in range(iterations):
        codebook, _ = update(vectors, codebook, reseed_below, seed + k)
    return codebook


def fit_batches(vectors: DataFrame, codes: int, batch: int = 1000, steps: int = 10, starts: int = 3, seed: int = 42) -> np.ndarray:
    """Mini-batch k-means: of several starts the one with the least error on a sample goes on, a batch of vectors at a time.

    A code moves to each batch's vectors by their share of all that it has been given. Batches are samples by digest;
    what reaches the driver is a batch, whatever the table's size.
    """
    drawn = lambda k: np.array([r["v"] for r in sample_vectors(vectors, batch, k).select("v").collect()], float)
    probe = drawn(seed)
    if not len(probe):
        return np.zeros((0, 0))
    error = lambda book: ((probe - book[nearest(probe, book)]) ** 2).sum()
    codebook = min((initial(vectors, codes, seed + k) for k in range(starts)), key=error)
    given = np.zeros(len(codebook))
    for k in range(steps):
        v = drawn(seed + 1000 + k)
        code = nearest(v, codebook)
        n = np.bincount(code, minlength=len(codebook))
        given += n
        for c in np.flatnonzero(n):
            codebook[c] += (v[code == c].mean(0) - codebook[c]) * n[c] / given[c]
    return codebook


def preset(images: DataFrame, name: str, size: int = 256, iterations: int = 10, sample: int = 500_000, seed: int = 0) -> Vq:
    """A vector quantiser in one of the usual shapes, trained on at most `sample` blocks of images."""
    block, codes = VQ_SHAPES[name]
    return Vq(fit(written(sample_vectors(blocks(images, block, size), sample, seed), "blocks"), codes, iterations, seed), size)


def hierarchical_preset(images: DataFrame, name: str, size: int = 256, sample: int = 100_000, seed: int = 42) -> HierarchicalVq:
    """A hierarchical quantiser in one of the usual shapes, each level trained by mini-batches on blocks of images."""
    made = []
    for block, codes in zip(*HVQ_SHAPES[name], strict=True):
        vectors = written(sample_vectors(blocks(images, block, size), sample, seed), "blocks")
        made.append(Vq(fit_batches(vectors, codes, seed=seed), size))
    return HierarchicalVq(tuple(made))


def save(codebook: np.ndarray, spark, path: str) -> None:
    """(code, centroid) as Parquet."""
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(codebook)], "code int, centroid array<double>").write.mode("overwrite").parquet(path)


def load(spark, path: str) -> np.ndarray:
    return np.array([r["centroid"] for r in spark.read.parquet(path).orderBy("code").collect()], float)
