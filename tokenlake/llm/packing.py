"""Best-fit packing by non-negative least squares over length patterns.

All documents are tokenised and cut into pieces of at most `size` tokens; their lengths form a
histogram with at most `size` entries, however large the corpus is. On the histogram alone:

1. patterns of at most three lengths that fill a sequence exactly are enumerated;
2. repeat counts are fitted to the histogram by non-negative least squares (accelerated projected
   gradient; a pattern touches three entries, so a step costs as much as there are patterns);
3. counts are rounded down to what the histogram holds;
4. what is left is packed best-fit decreasing, again by (length, count), not piece by piece.

The plan is a bounded list of (pattern, count). Each piece finds its place from its rank among
pieces of its length: ranks are counted within hash shards and shifted by the counts of earlier
shards, so no length, however frequent, meets in one task.

Defined results: a null or empty text is a document of the end token alone; repeated rows are
packed once each; null ids pass through; equal lengths take places by a hash of id and text; an empty
table gives an empty one; extra columns pass through in `rest`; a long text is tokenised in parts.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlake.llm.store import Scratch, text_batches


#: A letter or digit, one space, and a letter or digit.
_BETWEEN = re.compile(r"[^\W_] (?=[^\W_])")


@dataclass(frozen=True)
class Plan:
    """size: most tokens of a sequence; end: id after each document; vocabulary: file of byte-level BPE ranks,
    by default that of the public 50k vocabulary; a Hugging Face .json file is read by its own library, more slowly."""

    size: int = 1024
    end: int = 2
    vocabulary: str = ""


def cuts(text: str, step: int = 1 << 18) -> Iterator[str]:
    """Parts of a long text that begin with a single space before a word.

    Words of byte-level ranks carry the one space before them and nothing else spans it, so the parts' ids are the text's.
    """
    at = 0
    while len(text) - at > step:
        found = _BETWEEN.search(text, at + step)
        if not found:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:]


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids. A special token's string in a text is that token, as it is in the .json file."""
    import public_tokenizers

    public = public_tokenizers.path("byte_bpe_50k.tiktoken")
    path = path or public
    special = {"<|endoftext|>": 50256} if path == public else {}  # rank files name no special tokens
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    t = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: t.encode(text, allowed_special="all")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n - size * (-(-n // size) - 1)
    return [(0, first), *((at, size) for at in range(first, n, size))]


def _pieces(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(plan.vocabulary)
        names = ["rest", "rk", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                text = text.as_py() or ""
                # of other vocabularies it is not known where a text can be cut
                parts = [text] if plan.vocabulary.endswith(".json") else cuts(text)
                ids = np.concatenate([*(np.array(encode(x), "<u4") for x in parts), np.array([plan.end], "<u4")])
                for k, (at, n) in enumerate(cut(len(ids), plan.size)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names)

    return run


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of three lengths, longest first, 0 for none, that sum to size and occur among lengths."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    have[0] = True
    a, b = np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij")
    c = size - a - b
    good = (a >= b) & (b >= c) & (c >= 0) & (a > 0)
    good[good] &= have[c[good]]
    good &= ~((c > 0) & (b == 0))
    return np.stack([a[good], b[good], c[good]], 1)


def fit(table: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts x of the patterns that minimise the weighted squared error to the histogram.

    Errors at longer lengths weigh more, since what stays of them is harder to place.
    """
    size = len(histogram) - 1
    weight = np.sqrt(np.arange(size + 1) / size)
    weight[0] = 0
    scale = max(1.0, float(histogram.max()))
    target = weight * histogram / scale

    def forward(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(table[:, j], x, size + 1) for j in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        r = weight * r
        return r[table[:, 0]] + r[table[:, 1]] + r[table[:, 2]]

    v = np.ones(len(table))
    for _ in range(12):  # the largest curvature, by power iteration
        v = back(forward(v))
        top = float(np.linalg.norm(v))
        v /= top or 1.0
    x, y, t = np.zeros(len(table)), np.zeros(len(table)), 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(forward(y) - target) / (1.01 * top))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def pack(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up the histogram (counts by length 0..size) exactly."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    table = patterns(np.flatnonzero(left), size)
    if len(table):
        counts = fit(table, left)
        for k in np.argsort(-counts, kind="stable"):
            want = int(np.rint(counts[k]))
            if want < 1:
                break
            lengths = tuple(int(x) for x in table[k] if x)
            need = {x: lengths.count(x) for x in lengths}
            take = min([want, *(int(left[x]) // m for x, m in need.items())])
            if take > 0:
                out.append((lengths, take))
                for x, m in need.items():
                    left[x] -= m * take
    return out + _best_fit(left)


def _best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by (length, count): sequences with the same content are one entry with a count."""
    size = len(left) - 1
    room: dict[int, list[list]] = {}
    spaces = np.zeros(size + 1, bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            fits = np.flatnonzero(spaces[length:])
            if len(fits):
                space = length + int(fits[0])
                held = room[space].pop()
                take = min(count, held[1])
                if held[1] > take:
                    room[space].append([held[0], held[1] - take])
                if not room[space]:
                    spaces[space] = False
                content = (*held[0], length)
            else:
                per = size // length
                take, space, content = (count // per, per * length, (length,) * per) if count >= per else (1, count * length, (length,) * count)
                room.setdefault(size - space, []).append([content, take])
                spaces[size - space] = True
                count -= take * len(content)
                continue
            room.setdefault(space - length, []).append([content, take])
            spaces[space - length] = True
            count -= take
    return [(tuple(content), n) for held in room.values() for content, n in held]


def places(plan: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (first rank, first sequence, stride 0 for its repeats, offset) of each run of slots.

    Rank r of a length lies in the last run with first rank <= r; its sequence is first sequence + r - first rank.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, n in plan:
        at = 0
        for x in lengths:
            runs.setdefault(x, []).append((used.get(x, 0), base, at))
            used[x] = used.get(x, 0) + n
            at += x
        base += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for x, v in runs.items()}


def best_fit_packing(docs: DataFrame, plan: Plan = Plan(), shards: int | None = None) -> DataFrame:
    """(rest, piece, start, length, ids_crc32, sequence_id, offset) for each piece of docs(doc_id, text, ...)."""
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "packing")
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("rest"), F.xxhash64("doc_id", "text").alias("rk"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["rest"], *T._parse_datatype_string("rk long, piece int, start long, length long, ids_crc32 long").fields])
    pieces = scratch.write(rows.mapInArrow(_pieces(plan), schema), "pieces")
    total = pieces.count()
    # a shard's rows are sorted in one task: about 20,000 pieces each, however frequent a length is
    shards = shards or max(256, total // 20_000)
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("rk", "piece"), F.lit(shards)))
    counts = scratch.write(sharded.groupBy("length", "shard").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(plan.size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most plan.size rows
        histogram[length] = n
    slots = places(pack(histogram), plan.size)
    before = counts.select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    ranked = sharded.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "length").orderBy("rk", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "shard"]).withColumn("rank", F.col("rank") + F.col("before"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                of = length == x
                first, base, at = slots[x]
                k = np.searchsorted(first, rank[of], "right") - 1
                sequence[of], offset[of] = base[k] + rank[of] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], ["rest", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = T.StructType([rows.schema["rest"], *T._parse_datatype_string("piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").fields])
    return ranked.select("rest", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, out)
