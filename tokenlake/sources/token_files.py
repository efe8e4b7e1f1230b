"""Token files: flat, headered, npy and offsets; configurations, index folders and catalogues.

Flat: little-endian u16, each document's tokens, then the separator. Headered: u32 documents, u32
tokens per document, then tokens. Files are written by tasks through pyarrow's filesystems as rows
stream by, under another name first, so that a lost or repeated task leaves no half file. They are
read by ranges of bytes or of documents, each range a row that any task can take.
"""

from __future__ import annotations

import io
import itertools
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlake.functions.storage import written

SEPARATOR = 65535
#: Bytes of a file that one row stands for, and of tokens in one batch.
RANGE = 32 << 20
BATCH = 4 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI as Spark or anybody else writes it."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(f"{scheme}://{rest}" if rest.startswith("/") and not rest.startswith("//") else uri)


def _flattened(lists: pa.ListArray, after: int | None, kind: str) -> bytes:
    """The values of lists one after the other, each list followed by a value if there is one."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if after is not None:
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        values = np.insert(values, ends, after)
    return values.astype(kind).tobytes()


def _write(rows: DataFrame, uri: str, ending: str, begin: Callable[[int, int], bytes], body: Callable[[pa.RecordBatch, dict], bytes]) -> DataFrame:
    """Write rows(shard, doc_id, tokens, docs, n) as <uri>/<shard><ending>, documents by id; (shard, docs, bytes) of what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(uri)
        system.create_dir(path)
        out, state = None, {}

        def close() -> pa.RecordBatch:
            out.close()
            name = f"{path}/{state['shard']:05d}{ending}"
            system.move(state["name"], name)
            return pa.RecordBatch.from_arrays([pa.array([state[k]], pa.int64()) for k in ("shard", "docs", "bytes")], ["shard", "docs", "bytes"])

        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), batch.num_rows] if batch.num_rows else [0]):
                part = batch.slice(a, b - a)
                if out is None or state["shard"] != int(shards[a]):
                    if out is not None:
                        yield close()
                    state = {"shard": int(shards[a]), "docs": 0, "bytes": 0, "name": f"{path}/{uuid.uuid4().hex}.tmp"}
                    out = system.open_output_stream(state["name"])
                    raw = begin(part.column(3)[0].as_py(), part.column(4)[0].as_py())
                    out.write(raw)
                    state["bytes"] += len(raw)
                raw = body(part, state)
                out.write(raw)
                state["docs"] += b - a
                state["bytes"] += len(raw)
        if out is not None:
            yield close()

    keyed = rows.select(F.col("shard").cast("long").alias("shard"), "doc_id", "tokens", F.col("docs").cast("long").alias("docs"), F.col("n").cast("long").alias("n"))
    done = keyed.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(run, "shard long, docs long, bytes long")
    return written(done, "files")  # the files are there when this returns


def _sized(tokens: DataFrame) -> DataFrame:
    """tokens with the documents of their shard and their common length; shards of different lengths are an error."""
    sizes = tokens.groupBy("shard").agg(F.count("*").alias("docs"), F.min(F.size("tokens")).alias("n"), F.max(F.size("tokens")).alias("most"))
    n = F.when(F.col("n") == F.col("most"), F.col("n")).otherwise(F.raise_error(F.lit("documents of a shard differ in length")))
    return tokens.join(sizes.select("shard", "docs", n.alias("n")), "shard")


def _unsized(tokens: DataFrame) -> DataFrame:
    return tokens.withColumns({"docs": F.lit(0), "n": F.lit(0)})


def write_flat(tokens: DataFrame, uri: str, separator: int = SEPARATOR) -> DataFrame:
    """Write tokens(shard, doc_id, tokens) as <uri>/<shard>.bin."""
    return _write(_unsized(tokens), uri, ".bin", lambda docs, n: b"", lambda part, state: _flattened(part.column(2), separator, "<u2"))


def write_headered(tokens: DataFrame, uri: str) -> DataFrame:
    """Write tokens(shard, doc_id, tokens) of equal lengths as <uri>/<shard>.bin; the header counts what is written."""
    return _write(_sized(tokens), uri, ".bin", lambda docs, n: np.array([docs, n], "<u4").tobytes(), lambda part, state: _flattened(part.column(2), None, "<u2"))


def write_npy(tokens: DataFrame, uri: str, kind: str = "<u4") -> DataFrame:
    """Write tokens(shard, doc_id, tokens) of equal lengths as <uri>/<shard>.npy, a row for each document."""

    def begin(docs: int, n: int) -> bytes:
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": np.dtype(kind).str, "fortran_order": False, "shape": (docs, n)})
        return out.getvalue()

    return _write(_sized(tokens), uri, ".npy", begin, lambda part, state: _flattened(part.column(2), None, kind))


def write_offsets(tokens: DataFrame, uri: str) -> DataFrame:
    """Write where each document of tokens(shard, doc_id, tokens) begins, and the end, as u64 in <uri>/<shard>.offset."""

    def body(part: pa.RecordBatch, state: dict) -> bytes:
        ends = state.get("end", 0) + np.cumsum(part.column(2).value_lengths().to_numpy(zero_copy_only=False) + 1)
        state["end"] = int(ends[-1])
        return ends.astype("<u8").tobytes()

    return _write(_unsized(tokens), uri, ".offset", lambda docs, n: np.zeros(1, "<u8").tobytes(), body)


def concat_files(spark: SparkSession, pattern: str, out: str) -> int:
    """The bytes of all files of a pattern, by name, as one file, copied a piece at a time by one task; how many bytes."""
    names = [r["path"] for r in _listed(spark, pattern).select("path").orderBy("path").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, path = opened(out)
            system.create_dir(path.rsplit("/", 1)[0])
            part, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
            with system.open_output_stream(part) as sink:
                for name in names:
                    source, place = opened(name)
                    with source.open_input_stream(place) as file:
                        while piece := file.read(BATCH):
                            sink.write(piece)
                            size += len(piece)
            system.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], ["bytes"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "bytes long").first()["bytes"]


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, shard, length) of files; their contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(\.\w+)?$", 1).alias("shard"), "length")


def _lists(shard: str, first: int, values: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(shard, doc, tokens) of documents values[ends[i-1]:ends[i]], the first with number `first`, in batches of bounded size."""
    begin = np.append(0, ends[:-1])
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, begin[at] + BATCH)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin[at:to], ends[to - 1]) - begin[at], pa.int32()), pa.array(values[begin[at] : ends[to - 1]].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array([shard] * (to - at)), pa.array(np.arange(first + at, first + to)), lists], ["shard", "doc", "tokens"])
        at = to


_DOCS = "shard string, doc long, tokens array<int>"


def read_flat(spark: SparkSession, path: str, separator: int = SEPARATOR, size: int = RANGE) -> DataFrame:
    """(shard, doc, tokens) of flat files; tokens after a file's last separator are left out.

    Files are read in ranges of `size` bytes. A document belongs to the range that it begins in and is read to
    its separator; a first pass counts the separators of each range, so documents know their numbers.
    """
    size = max(2, size // 2 * 2)
    n = F.greatest(F.ceil(F.col("length") / size), F.lit(1)).cast("long")
    ranges = _listed(spark, path).select("path", "shard", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("part"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, part in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                system, place = opened(name)
                with system.open_input_file(place) as file:
                    raw = file.read_at(size, part * size)
                found.append(int((np.frombuffer(raw[: len(raw) // 2 * 2], "<u2") == separator).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], ["path", "shard", "length", "part", "seps"])

    seps = written(ranges.mapInArrow(counted, "path string, shard string, length long, part long, seps long"), "separators")
    first = F.sum("seps").over(Window.partitionBy("path").orderBy("part")) - F.col("seps")  # a row for each range, not for each document

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, shard, part, doc in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                system, place = opened(name)
                with system.open_input_file(place) as file:
                    start = part * size
                    before = separator if not start else int(np.frombuffer(file.read_at(2, start - 2), "<u2")[0])
                    raw = file.read_at(size, start)
                    values = np.frombuffer(raw[: len(raw) // 2 * 2], "<u2")
                    ends = np.flatnonzero(values == separator)
                    skip = 0
                    if before != separator:  # what begins before this range is read there
                        skip = int(ends[0]) + 1 if len(ends) else len(values)
                        doc, ends = doc + (skip <= len(values) and len(ends) > 0), ends[1:]
                    tail, at = [values[int(ends[-1]) + 1 if len(ends) else skip :]], start + len(raw)
                    open_ = len(values) > skip and not (len(ends) and ends[-1] == len(values) - 1)
                    while open_ and (more := file.read_at(BATCH, at)):
                        piece = np.frombuffer(more[: len(more) // 2 * 2], "<u2")
                        stop = np.flatnonzero(piece == separator)
                        tail.append(piece[: stop[0] + 1] if len(stop) else piece)
                        at += len(more)
                        if len(stop) or not len(piece):
                            break
                body, whole = values[skip : int(ends[-1]) + 1 if len(ends) else skip], ends - skip
                keep = body != separator
                yield from _lists(shard, doc, body[keep], whole - np.arange(len(whole)))
                rest = np.concatenate(tail)
                if open_ and len(rest) and rest[-1] == separator:
                    yield from _lists(shard, doc + len(whole), rest[:-1], np.array([len(rest) - 1]))

    return seps.select("path", "shard", "part", first.alias("doc")).repartition("path", "part").mapInArrow(parsed, _DOCS)


def _read_rows(spark: SparkSession, path: str, header: Callable[[object], tuple[int, int, int, str]], size: int) -> DataFrame:
    """(shard, doc, tokens) of files of documents of one length; header(file) gives (first byte, documents, tokens of each, kind)."""

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, shard, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                system, place = opened(name)
                with system.open_input_file(place) as file:
                    begin, docs, n, kind = header(file)
                width = n * np.dtype(kind).itemsize
                docs = min(docs, (length - begin) // width) if width else 0  # incomplete documents at the end are left out
                step = max(1, size // max(width, 1))
                out += [(name, shard, begin + at * width, at, min(step, docs - at), n, kind) for at in range(0, docs, step)]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "shard", "begin", "doc", "docs", "n", "kind"])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, shard, begin, doc, docs, n, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = opened(name)
                with system.open_input_file(place) as file:
                    values = np.frombuffer(file.read_at(docs * n * np.dtype(kind).itemsize, begin), kind)
                yield from _lists(shard, doc, values, n * np.arange(1, docs + 1))

    parts = _listed(spark, path).select("path", "shard", "length").mapInArrow(ranged, "path string, shard string, begin long, doc long, docs long, n long, kind string")
    return parts.repartition("path", "begin").mapInArrow(parsed, _DOCS)


def headered_header(file) -> tuple[int, int, int, str]:
    """(first byte, documents, tokens of each, kind) of a headered file."""
    docs, n = np.frombuffer(file.read_at(8, 0), "<u4").tolist()
    return 8, docs, n, "<u2"


def array_header(file) -> tuple[int, int, int, str]:
    """The same of an npy file."""
    head = io.BytesIO(file.read_at(1 << 16, 0))
    version = np.lib.format.read_magic(head)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran or kind.kind not in "iu" or len(shape) not in (1, 2):
        raise ValueError("only whole numbers in row order, in one or two dimensions")
    return head.tell(), shape[0], shape[1] if len(shape) == 2 else 1, kind.str


def read_headered(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(shard, doc, tokens) of headered files; incomplete documents at the end are left out."""
    return _read_rows(spark, path, headered_header, size)


def read_npy(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(shard, doc, tokens) of npy files of whole numbers: a document for each row of two dimensions, or one number each of one."""
    return _read_rows(spark, path, array_header, size)


def headered(tokens: list[list[int]]) -> bytes:
    """The bytes of a headered file; the header counts what is there."""
    n = len(tokens[0]) if tokens else 0
    return np.array([len(tokens), n], "<u4").tobytes() + np.array(tokens, "<u2").tobytes()


def documents_in(spark: SparkSession, path: str, tokens_per_document: int, width: int = 2) -> DataFrame:
    """(path, docs) from file sizes alone, for documents of one length with a separator each."""
    return spark.read.format("binaryFile").load(path).select("path", F.expr(f"length div {(tokens_per_document + 1) * width}").alias("docs"))


def write_config(spark: SparkSession, path: str, **settings) -> None:
    """One JSON row: vocab_size, tokens_per_image, separator_token, num_images, ..."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(path).first()["value"])


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def dataset_info(df: DataFrame) -> DataFrame:
    """(num_examples, features): the rows and the columns with their types; one row."""
    features = ", ".join(f"{k}: {t}" for k, t in df.dtypes)
    return df.agg(F.count("*").alias("num_examples")).withColumn("features", F.lit(features))


def catalogue(spark: SparkSession, entries: list[dict], out: str) -> list[dict]:
    """The entries (name, path, expected_size, ...) in their order whose output <out>/<name> is not there yet."""
    return [e for e in entries if not exists(spark, f"{out}/{e['name']}/_SUCCESS")]


def write_index(index: DataFrame, path: str, if_exists: str = "ignore") -> None:
    """An n-gram index by shard and length; an index that is there is left alone unless told otherwise."""
    index.write.mode(if_exists).partitionBy("shard", "n").parquet(path)


def build_shards(spark: SparkSession, path: str, shards: list[int], build: Callable[[int], DataFrame]) -> list[int]:
    """Write build(shard) as <path>/shard=<shard> for each shard that is not complete there; the shards that were built.

    A shard is complete when its writer has committed, so a stopped run goes on where it ended.
    """
    todo = [k for k in shards if not exists(spark, f"{path}/shard={k}/_SUCCESS")]
    for k in todo:
        build(k).drop("shard").write.mode("overwrite").partitionBy("n").parquet(f"{path}/shard={k}")
    return todo


def read_index(spark: SparkSession, path: str, first: int | None = None, count: int | None = None) -> DataFrame:
    """All shards of an index, or `count` from `first`; other partitions are not opened."""
    out = spark.read.option("basePath", path).parquet(path)
    return out if first is None else out.filter((F.col("shard") >= first) & (F.col("shard") < first + (count or 1)))
