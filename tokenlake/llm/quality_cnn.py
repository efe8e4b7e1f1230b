"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of `width` bytes move over each chunk of `chunk` bytes in steps
of `stride`. Chunks overlap by what a filter sees past its first bytes, so every window of the
document lies in one of them. Each filter's largest response in a chunk is kept (max-pooling); a
document's features are the mean, maximum and minimum of its chunks' responses (a chunk that repeats
itself answers to few filters), and a logistic layer
makes one probability of them. Training is plain back-propagation with Adam: only the place of
the maximum passes a gradient on.

The network is fitted on a bounded sample (Plan.sample labelled texts of at most Plan.longest
characters) and scores whole texts.

Defined results: null and empty texts are one chunk of zero bytes; documents without a label are
scored only; several labels of one document count with their mean; without labelled rows, or with
one class alone, every score is the share of that class (0.5 without any); null ids and repeated
rows are scored row by row; extra columns are not looked at; an empty table gives an empty one; a text
of any length is scored whole, a few chunks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.arrays import ranges, texts
from tokenlake.llm.store import text_batches

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Plan:
    """Shape of the network, bounds of the sample, and how long to train."""

    embedding: int = 4
    width: int = 16
    stride: int = 4
    filters: int = 24
    chunk: int = 512
    sample: int = 3000
    longest: int = 20_000
    epochs: int = 10
    batch: int = 32
    rate: float = 0.01
    seed: int = 11


class ByteCNN:
    """The weights and both passes."""

    def __init__(self, plan: Plan = Plan()):
        self.plan = plan
        r = np.random.default_rng(plan.seed)
        window = plan.width * plan.embedding
        self.w = {
            "embed": r.normal(0, 0.5, (256, plan.embedding)).astype(np.float32),
            "filter": r.normal(0, window**-0.5, (window, plan.filters)).astype(np.float32),
            "bias": np.zeros(plan.filters, np.float32),
            "out": r.normal(0, 0.1, 3 * plan.filters).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }
        self.share: float | None = 0.5

    def places(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start and length of each chunk, chunks of each document)."""
        p = self.plan
        size = np.diff(offsets)
        n = np.maximum(1, -(-size // p.chunk))
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(offsets[:-1], n) + row * p.chunk
        return at, np.clip(np.repeat(offsets[1:], n) - at, 0, p.chunk + p.width - p.stride), n

    def rows(self, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The bytes of some chunks, a row each."""
        wide = self.plan.chunk + self.plan.width - self.plan.stride
        out = np.zeros((len(at), wide), np.uint8)
        out.reshape(-1)[ranges(np.arange(len(at)) * wide, length)] = data[ranges(at, length)]
        return out

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all chunks, a row each; chunks of each document)."""
        at, length, n = self.places(offsets)
        return self.rows(data, at, length), n

    def pool(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest response, its place) of each filter in each chunk."""
        p = self.plan
        k, blocks = p.width // p.stride, rows.shape[1] // p.stride
        part = p.stride * p.embedding
        x = self.w["embed"][rows].reshape(len(rows) * blocks, part)
        w = self.w["filter"].reshape(k, part, p.filters).transpose(1, 0, 2).reshape(part, k * p.filters)
        z = (x @ w).reshape(len(rows), blocks, k, p.filters)
        places = blocks - k + 1
        y = z[:, :places, 0].copy()
        for j in range(1, k):
            y += z[:, j : j + places, j]
        at = y.argmax(1)
        return np.take_along_axis(y, at[:, None], 1)[:, 0] + self.w["bias"], at

    def features(self, rows: np.ndarray, n: np.ndarray):
        raw, at = self.pool(rows)
        m = np.maximum(raw, 0)
        first = np.cumsum(n) - n
        return raw, at, m, self.joined(m, n, first), first

    @staticmethod
    def joined(m: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean, maximum and minimum over each document's chunks."""
        return np.concatenate([np.add.reduceat(m, first) / n[:, None], np.maximum.reduceat(m, first), np.minimum.reduceat(m, first)], 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each document."""
        if self.share is not None:
            return np.full(len(offsets) - 1, self.share)
        at, length, n = self.places(offsets)
        pooled = np.concatenate([self.pool(self.rows(data, at[k : k + 128], length[k : k + 128]))[0] for k in range(0, len(at), 128)])
        m, first = np.maximum(pooled, 0), np.cumsum(n) - n
        f = self.joined(m, n, first)
        return 1 / (1 + np.exp(-(f @ self.w["out"] + self.w["base"][0]).astype(float)))

    def fit(self, samples: list[bytes], labels: np.ndarray) -> ByteCNN:
        """Train on whole texts; labels between 0 and 1."""
        if len(samples) == 0 or labels.min() == labels.max():
            self.share = float(labels.mean()) if len(samples) else 0.5
            return self
        self.share = None
        p, r = self.plan, np.random.default_rng(self.plan.seed + 1)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(p.epochs):
            rate = p.rate * (1 - epoch / p.epochs) + 1e-4
            order = r.permutation(len(samples))
            for k in range(0, len(order), p.batch):
                of = order[k : k + p.batch]
                grads = self._gradients([samples[i] for i in of], labels[of])
                step += 1
                for name, g in grads.items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    self.w[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, samples: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        p = self.plan
        data = np.frombuffer(b"".join(samples), np.uint8)
        rows, n = self.chunks(data, np.cumsum([0, *(len(x) for x in samples)]))
        raw, at, m, f, first = self.features(rows, n)
        d = (1 / (1 + np.exp(-(f @ self.w["out"] + self.w["base"][0]))) - labels) / len(labels)
        own = np.repeat(np.arange(len(n)), n)
        g = d[own, None] * self.w["out"][: p.filters] / n[own, None]
        for k in (1, 2):
            part = slice(k * p.filters, (k + 1) * p.filters)
            there = (m == f[own, part]).astype(float)
            g += d[own, None] * self.w["out"][part] * there / np.add.reduceat(there, first)[own]  # equal chunks share it
        g = (g * (raw > 0)).astype(np.float32)
        place = at[:, :, None] * p.stride + np.arange(p.width)
        seen = rows[np.arange(len(rows))[:, None, None], place]
        x = self.w["embed"][seen].reshape(len(rows), p.filters, -1)
        back = (g[:, :, None] * self.w["filter"].T[None]).reshape(-1, p.embedding)
        embed = np.stack([np.bincount(seen.reshape(-1), back[:, j], 256) for j in range(p.embedding)], 1)
        return {
            "embed": embed.astype(np.float32), "filter": np.einsum("cf,cfw->wf", g, x), "bias": g.sum(0),
            "out": (f.T @ d).astype(np.float32), "base": np.array([d.sum()], np.float32),
        }


def fit(docs: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> ByteCNN:
    """Train on docs(doc_id, text) with labels(doc_id, quality); the labelled sample is at most plan.sample rows."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    n = one.count()
    part = one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003 < F.lit(plan.sample / max(n, 1))).limit(plan.sample)
    # the sample is bounded by plan.sample rows of two numbers
    rows = docs.filter(F.length("text") <= plan.longest).join(F.broadcast(part), "doc_id").select("text", "quality").orderBy("text", "quality").limit(2 * plan.sample).collect()
    return ByteCNN(plan).fit([r["text"].encode() for r in rows], np.array([r["quality"] for r in rows], np.float32))


def score_quality(docs: DataFrame, model: ByteCNN, held_out) -> DataFrame:
    """SCHEMA for each row of docs(doc_id, text); held_out: a column, passed through only."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in texts(batch, "text"):
                score = shared.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(score.astype(float)), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    return rows.mapInArrow(run, SCHEMA)
