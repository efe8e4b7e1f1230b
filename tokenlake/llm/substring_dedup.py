"""Substring deduplication with a log-structured fingerprint index.

Documents come in batches. Windows of `window` words are reduced to content-defined blocks
(tokenlake.llm.blocks); a block's fingerprints are the hash of its anchor and the hash of all words
that its windows cover. The index keeps the fingerprints of all earlier batches in sorted immutable
runs, bucketed by anchor, and the earlier texts, bucketed by row. For a batch,

1. its own fingerprints become a run, one entry for each distinct block;
2. each historical run is merge-joined with that run on the anchor; neither side is shuffled;
3. what both hold is verified. A block whose words as a whole also stand in an earlier document is
   covered whole. Of blocks that share an anchor only, the windows are compared one by one, by two
   independent 64-bit hashes of their words; historical windows come from the stored texts of just
   the rows that the join named, again without a shuffle of texts;
4. the run joins the index; `fanout` runs of one level are compacted into one of the next.

A later batch never changes what an earlier one kept, so results are final batch by batch, and an
index in a folder can be opened again for further tables. Equality rests on hashes of whole windows
or whole blocks: 128 bits for windows, 64 bits within an anchor's 64 for blocks.

Defined results: a null text has no words; a null doc_id is never smaller than another and counts
as larger than all; repeated rows of one doc_id in a batch never remove each other; an empty table
gives an empty one; extra columns pass through untouched; a text of any length is taken in segments.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.llm import blocks
from tokenlake.llm.arrays import IS_SPACE, SEGMENT, Words, covered, fields, grams, ranges, segments, texts
from tokenlake.llm.store import Scratch, text_batches

_LAST = 2**63 - 1
#: What stands in the index is older than any document of a batch.
_OLD = -(2**63)


@dataclass(frozen=True)
class Plan:
    """window: words that must repeat; gram: words of a fingerprint; batches: parts that a table is taken in;
    fanout: runs of one level that are compacted into one."""

    window: int = 50
    gram: int = 8
    batches: int = 3
    fanout: int = 2


def _found(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rk, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offsets in texts(batch, "text"):
                words = Words(data, offsets)
                got = blocks.find(words.hash, words.first, plan.window, plan.gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rk[lo:hi][got["doc"]]), pa.array(d[lo:hi][got["doc"]]), pa.array(got["anchor"]), pa.array(got["body"]), pa.array(got["a"].astype(np.int32)), pa.array(got["n"].astype(np.int32))],
                    ["rk", "d", "anchor", "body", "a", "n"],
                )

    return run


def _finish(raw: bytes, gone: np.ndarray | None, with_text: bool) -> list:
    """[words, words removed, hash of the rest, the rest if asked]; words are split a segment of the text at a time."""
    n, removed, digest, kept, some = 0, 0, hashlib.sha256(), [], False
    for a, b in segments(np.frombuffer(raw, np.uint8), IS_SPACE):
        words = raw[a:b].split()
        if gone is not None:
            own = gone[n : n + len(words)]
            removed += int(own.sum())
            rest = [w for w, g in zip(words, own.tolist(), strict=True) if not g]
        else:
            rest = words
        n += len(words)
        if rest:
            part = (b" " if some else b"") + b" ".join(rest)
            some = True
            digest.update(part)
            if with_text:
                kept.append(part)
    return [n, removed, digest.hexdigest(), b"".join(kept).decode() if with_text else None]


def _hashes(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that begin at some words of one text."""
    offsets = np.array([0, len(data)])
    return tuple(grams(Words(data, offsets, seed=s).hash, window, seed=s)[starts].view(np.int64) for s in (0, 1))


_DONE = "n_words long, n_removed long, kept_sha256 string, kept_text string, z binary, a binary, n binary, starts binary, f1 binary, f2 binary"


def _half(plan: Plan, with_text: bool):
    """Finish documents without single windows to compare; pack the others with those windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            todo = batch.column(4)
            for i, text in enumerate(batch.column(2)):
                raw = (text.as_py() or "").encode()
                row: list = [None] * 10
                if not todo[i].is_valid:
                    row[:4] = _finish(raw, None, with_text)
                else:
                    a, n, full = fields(todo, i, "a", "n", "full")
                    a, n, full = a.astype(np.int64), n.astype(np.int64), full.astype(bool)
                    if full.all():
                        gone = covered(len(raw) // 2 + 1, a, a + n - 1 + plan.window)  # no text has more words
                        row[:4] = _finish(raw, gone, with_text)
                    else:
                        starts = ranges(a[~full], n[~full])
                        f1, f2 = _hashes(np.frombuffer(raw, np.uint8), starts, plan.window)
                        row[4:] = [press.compress(raw), a[full].tobytes(), n[full].tobytes(), starts.tobytes(), f1.tobytes(), f2.tobytes()]
                for k, x in enumerate(row):
                    out[k].append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * 6]
            names = [x.split()[0] for x in _DONE.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], ["rk", "d", "rest", *names])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed windows, a row each."""
    for batch in batches:
        rk, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i in range(batch.num_rows):
            starts, f1, f2 = (np.frombuffer(batch.column(k)[i].as_py(), np.int64) for k in (2, 3, 4))
            for k in range(0, len(starts), SEGMENT):
                part = slice(k, k + SEGMENT)
                size = len(starts[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, rk[i])), pa.array(np.full(size, d[i])), pa.array(starts[part].astype(np.int32)), pa.array(f1[part]), pa.array(f2[part])], ["rk", "d", "start", "f1", "f2"])


def _old_windows(plan: Plan):
    """(f1, f2) of the listed blocks' windows of stored texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(0)):
                a, n = fields(batch.column(1), i, "a", "n")
                f1, f2 = _hashes(np.frombuffer((text.as_py() or "").encode(), np.uint8), np.unique(ranges(a.astype(np.int64), n)), plan.window)
                for k in range(0, len(f1), SEGMENT):
                    yield pa.RecordBatch.from_arrays([pa.array(f1[k : k + SEGMENT]), pa.array(f2[k : k + SEGMENT])], ["f1", "f2"])

    return run


def _rest(plan: Plan, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for z, a, n, hits in zip(*(batch.column(k) for k in (1, 2, 3, 4)), strict=True):
                raw = open_.decompress(z.as_py())
                a, n = (np.frombuffer(x.as_py(), np.int64) for x in (a, n))
                single = hits.values.to_numpy().astype(np.int64) if hits.is_valid else a[:0]
                gone = covered(len(raw) // 2 + 1, np.append(a, single), np.append(a + n - 1, single) + plan.window)
                for k, x in enumerate(_finish(raw, gone, with_text)):
                    out[k].append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], ["rest", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _shaped(docs: DataFrame) -> DataFrame:
    others = [c for c in docs.columns if c != "text"]
    return docs.select(
        F.xxhash64(F.col("doc_id").cast("long"), "text").alias("rk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"),
        F.col("text").cast("string").alias("text"), F.struct(*others).alias("rest"),
    )


_ENTRY = "anchor long, body long, d long, rk long, a int, n int"


class FingerprintIndex:
    """Runs of block fingerprints and the texts they stand in, in one folder.

    run-<name>: `_ENTRY`, one row for each distinct (anchor, body), bucketed and sorted by anchor.
    texts/<name>: (rk, text) of a batch, bucketed and sorted by rk.
    manifest/v=<n>: the runs with their levels, the texts, the buckets and the plan, as JSON; the last one counts.
    """

    def __init__(self, spark: SparkSession, folder: str, plan: Plan = Plan()):
        """Open the index of a folder, or begin one; an index that is there keeps its own plan and buckets."""
        self.spark, self.folder, self.plan = spark, folder.rstrip("/"), plan
        self.runs: list[tuple[int, str]] = []
        self.texts: list[str] = []
        self.buckets, self.version = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            last = spark.read.text(f"{self.folder}/manifest").orderBy(F.desc("v")).first()
            known = json.loads(last["value"])
            self.version, self.buckets, self.plan = last["v"], known["buckets"], Plan(**known["plan"])
            self.runs, self.texts = [tuple(x) for x in known["runs"]], known["texts"]
        # a bucket is one sorted file, so a merge join need not sort it again
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self._open: dict[str, str] = {}

    def _table(self, name: str, schema: str, key: str) -> DataFrame:
        """A bucketed table of the folder, by a name of this session."""
        if name not in self._open:
            self._open[name] = f"tokenlake_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self._open[name]} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(self._open[name])

    def _write(self, df: DataFrame, name: str, key: str) -> DataFrame:
        self._open[name] = f"tokenlake_{uuid.uuid4().hex}"
        writer = df.repartition(self.buckets, key).write.format("parquet").option("compression", "zstd").option("path", f"{self.folder}/{name}")
        writer.bucketBy(self.buckets, key).sortBy(key).saveAsTable(self._open[name])
        return self.spark.table(self._open[name])

    def run(self, name: str) -> DataFrame:
        return self._table(name, _ENTRY, "anchor").select("anchor", "body", "d", "rk", "a", "n")

    def _forget(self, name: str) -> None:
        if (table := self._open.pop(name, None)) is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self, delete: bool = False) -> None:
        """Drop this session's table names; the files stay unless they are to be deleted."""
        for table in self._open.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._open.clear()
        if delete:
            self._forget(".")

    def _commit(self) -> None:
        self.version += 1
        known = {"runs": self.runs, "texts": self.texts, "buckets": self.buckets, "plan": asdict(self.plan)}
        self.spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/v={self.version}")

    def compact(self) -> None:
        """Merge the runs of each level that has `fanout` of them into one of the next level."""
        level = 0
        while level <= max((x for x, _ in self.runs), default=-1):
            own = [name for x, name in self.runs if x == level]
            if len(own) >= self.plan.fanout:
                every = self.run(own[0])
                for name in own[1:]:
                    every = every.unionByName(self.run(name))
                # entries of a run are distinct, so a task meets a fingerprint once for each run
                kept = every.repartition(self.buckets, "anchor").groupBy("anchor", "body").agg(F.min(F.struct("d", "rk", "a", "n")).alias("e")).select("anchor", "body", "e.*")
                merged = f"run-{uuid.uuid4().hex}"
                self._write(kept, merged, "anchor")
                self.runs = [x for x in self.runs if x[1] not in own] + [(level + 1, merged)]
                self._commit()
                for name in own:
                    self._forget(name)
            level += 1

    def deduplicate(self, docs: DataFrame, with_text: bool = False, keep: bool = True) -> DataFrame:
        """Judge docs(doc_id, text, ...) against all that the index holds and among themselves, then add them to it.

        (rest, n_words, n_removed, kept_sha256, kept_text) for each row; a written table. Without keep, as for the last
        batch of all, the index stays as it was.
        """
        plan, spark = self.plan, self.spark
        text_batches(spark)
        scratch = Scratch(spark, "substring-dedup")
        rows = _shaped(docs)
        rest_type = rows.schema["rest"]
        found = scratch.write(rows.select("rk", "d", "text").mapInArrow(_found(plan), "rk long, d long, anchor long, body long, a int, n int"), "found")
        name = uuid.uuid4().hex
        entries = found.groupBy("anchor", "body").agg(F.min(F.struct("d", "rk", "a", "n")).alias("e"), F.max("d").alias("most"))
        own = self._write(entries.select("anchor", "body", "e.*", "most"), f"run-{name}", "anchor")
        store = self._write(rows.select("rk", "text", "d", "rest"), f"texts/{name}", "rk") if keep else rows

        # merge joins of sorted runs: which anchors stand in history or in two documents, and with how many bodies
        mine = own.groupBy("anchor").agg(F.min("body").alias("lo"), F.max("body").alias("hi"), (F.min("d") < F.max("most")).alias("several"))
        old = None
        for _, run in self.runs:
            part = self.run(run).hint("merge").join(mine.select("anchor"), "anchor", "left_semi")
            old = part if old is None else old.unionByName(part)
        if old is None:
            old = spark.createDataFrame([], _ENTRY)
        old = scratch.write(old, "old")
        theirs = old.groupBy("anchor").agg(F.min("body").alias("old_lo"), F.max("body").alias("old_hi"))
        shared = mine.join(theirs, "anchor", "left").filter("several or old_lo is not null")
        shared = scratch.write(shared.select("anchor", (F.least("lo", "old_lo") < F.greatest("hi", "old_hi")).alias("mixed")), "anchors")
        some = scratch.write(found.join(shared, "anchor"), "shared")
        scratch.drop("found")

        # whole blocks
        known = old.select("anchor", "body").distinct().withColumn("old", F.lit(True))
        bodies = own.select("anchor", "body", F.col("d").alias("least")).join(shared.select("anchor"), "anchor", "left_semi").join(known, ["anchor", "body"], "left")
        bodies = scratch.write(bodies.select("anchor", "body", F.when(F.col("old"), F.lit(_OLD)).otherwise(F.col("least")).alias("least")), "bodies")
        judged = some.join(bodies, ["anchor", "body"]).filter("d > least or mixed")
        # rows of one id and text are judged alike: their blocks are listed once
        per = judged.groupBy("rk").agg(F.collect_set(F.struct("a", "n", (F.col("d") > F.col("least")).alias("full"))).alias("todo"))
        joined = store.hint("merge").join(per, "rk", "left").select("rk", "d", "text", "rest", "todo")
        schema = T.StructType([T.StructField("rk", T.LongType()), T.StructField("d", T.LongType()), rest_type, *T._parse_datatype_string(_DONE).fields])
        half = scratch.write(joined.mapInArrow(_half(plan, with_text), schema), "half")

        # single windows
        open_ = half.filter("z is not null")
        windows = open_.select("rk", "d", "starts", "f1", "f2").mapInArrow(_windows, "rk long, d long, start int, f1 long, f2 long")
        every = windows.select("f1", "f2", "d")
        wanted = old.join(shared.filter("mixed").select("anchor"), "anchor", "left_semi").groupBy("rk").agg(F.collect_set(F.struct("a", "n")).alias("todo"))
        if self.texts:
            wanted = scratch.write(wanted, "wanted")
            for k, batch in enumerate(self.texts):
                stored = self._table(f"texts/{batch}", "rk long, text string", "rk").select("rk", "text").hint("merge").join(wanted, "rk")
                past = scratch.write(stored.select("text", "todo").mapInArrow(_old_windows(plan), "f1 long, f2 long"), f"past-{k}")
                every = every.unionByName(past.withColumn("d", F.lit(_OLD)))
        least = every.groupBy("f1", "f2").agg(F.min("d").alias("least"), F.max("d").alias("most")).filter("least < most").select("f1", "f2", "least")
        hits = windows.join(least, ["f1", "f2"]).filter("d > least").groupBy("rk").agg(F.collect_set("start").alias("hits"))
        out_schema = T.StructType([rest_type, *T._parse_datatype_string("n_words long, n_removed long, kept_sha256 string, kept_text string").fields])
        late = open_.join(hits, "rk", "left").select("rest", "z", "a", "n", "hits").mapInArrow(_rest(plan, with_text), out_schema)
        done = half.filter("z is null").select("rest", "n_words", "n_removed", "kept_sha256", "kept_text").unionByName(late)
        done = scratch.write(done, "done")
        scratch.drop("old", "anchors", "shared", "bodies", "half", "wanted", *(f"past-{k}" for k in range(len(self.texts))))
        if keep:
            self.runs.append((0, f"run-{name}"))
            self.texts.append(name)
            self._commit()
            self.compact()
        else:
            self._forget(f"run-{name}")
        return done


def _parts(docs: DataFrame, batches: int) -> Iterator[DataFrame]:
    """docs by ranges of doc_id, the least first; null ids are in the last part."""
    low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    low, high = (0, 0) if low is None else (low, high)
    cuts = [low + (high - low + 1) * k // batches for k in range(1, batches)]
    for a, b in zip([None, *cuts], [*cuts, None], strict=True):
        above = F.lit(True) if a is None else F.col("doc_id") >= a
        below = F.lit(True) if b is None else F.col("doc_id") < b
        yield docs if a is None and b is None else docs.filter((above & below) if b is not None else (above | F.col("doc_id").isNull()))


def substring_dedup(docs: DataFrame, plan: Plan = Plan(), with_text: bool = False) -> DataFrame:
    """(rest, n_words, n_removed, kept_sha256, kept_text) for each row of docs(doc_id, text, ...).

    rest: a struct of all columns but text; kept_text: the words that stay, if with_text. The table goes through
    an index of its own, a batch of ids after the other.
    """
    index = FingerprintIndex(docs.sparkSession, Scratch(docs.sparkSession, "fingerprints").root, plan)
    out = None
    for k, part in enumerate(_parts(docs, plan.batches)):
        done = index.deduplicate(part, with_text, keep=k + 1 < plan.batches)
        out = done if out is None else out.unionByName(done)
    index.close(delete=True)
    return out
