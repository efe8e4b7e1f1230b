"""Token files as a Spark data source: spark.read.format("tokens"), SQL's USING tokens, and streams of files.

    token_source.register(spark)
    spark.read.format("tokens").option("layout", "flat").load(folder)
    CREATE TEMPORARY VIEW t USING tokens OPTIONS (path '...', layout 'npy')
    df.write.format("tokens").mode("append").save(folder)
    spark.readStream.format("tokens").load(folder) ... writeStream.format("tokens")

Rows are (shard, start, tokens): the file's name without its ending, the tokens (separators too) before
the document in its file, and its tokens. Options: layout (flat, headered or npy), separator and range, the
bytes of a file that one task reads at a time, and shards, the names (a,b,c) of those to read; other files are not
opened. Conditions are not pushed down: Spark keeps what one query pushed to a reader for the next that uses the same table.

Reading: a task takes one range after the other, of one or more files, together at least `share` bytes (1 MB by default), so that small
ranges are not a task each. A flat document belongs to the range in which it begins and is read
to its separator, whatever lies between; tokens after a file's last separator are left out. Planning
lists files and reads the headers of headered and npy files.

Writing (flat): each task writes its rows, in their order, to a file of its own under another name. When all
have ended, files get the next free numbers; if one fails, all are deleted, so a folder never has half
a write. A stream's files are named by batch, and a batch that is run again replaces its own.

A stream of files takes them in the order of their names, at most `files` a batch if that is set; new names must come after those read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)

from tokenlake.sources.token_files import BATCH, RANGE, SEPARATOR, array_header, headered_header, opened

SCHEMA = "shard string, start long, tokens array<int>"


@dataclass
class Range(InputPartition):
    """Of a file, bytes of flat tokens or documents of one length (n, kind)."""

    path: str
    shard: str
    begin: int
    size: int
    n: int = -1
    kind: str = "<u2"
    first: int = 0


@dataclass
class Share(InputPartition):
    """Ranges that one task reads."""

    ranges: list[Range]


@dataclass
class Written(WriterCommitMessage):
    task: int
    name: str | None


def files(path: str, ending: str) -> list[tuple[str, str, int]]:
    """(path, name without ending, bytes) of a file or of the files of a folder, by name."""
    system, place = opened(path)
    info = system.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place)) if info.type == fs.FileType.Directory else []
    head = path[: len(path) - len(place)] if path.endswith(place) else ""
    return sorted((head + x.path, x.base_name.rsplit(".", 1)[0], x.size) for x in found if x.type == fs.FileType.File and x.base_name.endswith(ending) and x.base_name[0] not in "._")


def flat_documents(file, begin: int, size: int, separator: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(starts, tokens with separators, places of separators) of the documents that begin in a range of bytes."""
    read = lambda at, n: np.frombuffer((raw := file.read_at(n, at))[: len(raw) // 2 * 2], "<u2")
    values, skip = read(begin, size), 0
    if begin and read(begin - 2, 2)[0] != separator:
        stops = np.flatnonzero(values == separator)
        skip = int(stops[0]) + 1 if len(stops) else len(values)
    values = values[skip:]
    if not len(values):
        return None
    parts, at = [values], begin + size
    while parts[-1][-1] != separator and len(more := read(at, BATCH)):
        stops = np.flatnonzero(more == separator)
        parts.append(more[: int(stops[0]) + 1] if len(stops) else more)
        at += BATCH
    values = np.concatenate(parts)
    ends = np.flatnonzero(values == separator)
    return begin // 2 + skip + np.append(0, ends[:-1] + 1), values, ends


def _batches(shard: str, starts: np.ndarray, values: np.ndarray, first: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents values[first:first+length], in batches of bounded size; nothing stands between them but one separator at most."""
    at, total = 0, np.cumsum(length)
    while at < len(length):
        to = max(at + 1, int(np.searchsorted(total, total[at] - length[at] + BATCH, "right")))
        keep = np.ones(int(first[to - 1] + length[to - 1] - first[at]), bool)
        keep[(first[at:to] + length[at:to] - first[at])[:-1][np.diff(first[at:to]) > length[at : to - 1]]] = False
        tokens = values[first[at] : first[to - 1] + length[to - 1]][keep].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length[at:to])), pa.int32()), pa.array(tokens))
        yield pa.RecordBatch.from_arrays([pa.array([shard] * (to - at)), pa.array(starts[at:to], pa.int64()), lists], ["shard", "start", "tokens"])
        at = to


class Options:
    def __init__(self, options):
        self.path, self.layout = options.get("path"), options.get("layout", "flat")
        if not self.path or self.layout not in ("flat", "headered", "npy"):
            raise ValueError("a path and a layout of flat, headered or npy")
        self.separator, self.range = int(options.get("separator", SEPARATOR)), max(2, int(options.get("range", RANGE)) // 2 * 2)
        self.shards = {x.strip() for x in options["shards"].split(",")} if options.get("shards") else None
        self.files, self.ending = int(options.get("files", 1 << 30)), ".npy" if self.layout == "npy" else ".bin"
        self.share = int(options.get("share", 1 << 20))

    def found(self) -> list[tuple[str, str, int]]:
        return [x for x in files(self.path, self.ending) if self.shards is None or x[1] in self.shards]

    def ranges(self, found: list[tuple[str, str, int]]) -> list[Range]:
        out = []
        for path, shard, size in found:
            if self.layout == "flat":
                out += [Range(path, shard, at, self.range) for at in range(0, size, self.range)]
                continue
            system, place = opened(path)
            with system.open_input_file(place) as file:
                begin, docs, n, kind = (array_header if self.layout == "npy" else headered_header)(file)
            width = n * np.dtype(kind).itemsize
            docs = min(docs, (size - begin) // width) if width else 0
            step = max(1, self.range // max(width, 1))
            out += [Range(path, shard, begin + k * width, min(step, docs - k), n, kind, k * n) for k in range(0, docs, step)]
        return out

    def shares(self, found: list[tuple[str, str, int]]) -> list[Share]:
        ranges = self.ranges(found)
        each = max(1, self.share // self.range)
        return [Share(ranges[k : k + each]) for k in range(0, len(ranges), each)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        for part in share.ranges:
            yield from self._read(part)

    def _read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, place = opened(part.path)
        with system.open_input_file(place) as file:
            if part.n < 0:
                if (found := flat_documents(file, part.begin, part.size, self.separator)) is not None:
                    starts, values, ends = found
                    first = np.append(0, ends[:-1] + 1)[: len(ends)]
                    yield from _batches(part.shard, starts[: len(ends)], values, first, ends - first)
                return
            values = np.frombuffer(file.read_at(part.size * part.n * np.dtype(part.kind).itemsize, part.begin), part.kind)
        first = np.arange(part.size) * part.n
        yield from _batches(part.shard, part.first + first, values, first, np.full(part.size, part.n))


class Reader(DataSourceReader):
    def __init__(self, options: Options):
        self.options = options

    def partitions(self) -> list[Share]:
        return self.options.shares(self.options.found())

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.options.read(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: Options):
        self.options, self.last = options, ""

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        new = [shard for _, shard, _ in self.options.found() if shard > self.last][: self.options.files]
        self.last = new[-1] if new else self.last
        return {"last": self.last}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        self.last = max(self.last, end["last"])  # after a restart
        return self.options.shares([x for x in self.options.found() if start["last"] < x[1] <= end["last"]])

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.options.read(partition)


class _Files:
    """Files of tasks, which are renamed together."""

    def __init__(self, options: Options, column: int, overwrite: bool):
        if options.layout != "flat":
            raise ValueError("only flat files can be written")
        self.options, self.column, self.overwrite = options, column, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = opened(self.options.path)
        system.create_dir(path)
        task, name, out = TaskContext.get().partitionId(), f"{path}/.{uuid.uuid4().hex}.tmp", None
        for batch in iterator:
            if batch.num_rows:
                out = out or system.open_output_stream(name)
                lists = batch.column(self.column)
                values = lists.flatten().to_numpy(zero_copy_only=False)
                if len(values) and not (0 <= values.min() and values.max() <= 65535 and (values != self.options.separator).all()):
                    raise ValueError("tokens are numbers from 0 to 65535 other than the separator")
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                out.write(np.insert(values, ends, self.options.separator).astype("<u2").tobytes())
        if out is not None:
            out.close()
        return Written(task, None if out is None else name)

    def renamed(self, messages: list[Written | None], name) -> None:
        system, path = opened(self.options.path)
        for k, x in enumerate(sorted((x for x in messages if x and x.name), key=lambda x: x.task)):
            system.move(x.name, f"{path}/{name(k)}")

    def dropped(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.options.path)
        for x in messages:
            if x and x.name:
                system.delete_file(x.name)


class Writer(_Files, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        old = files(self.options.path, ".bin")
        free = 0 if self.overwrite else 1 + max((int(s) for _, s, _ in old if s.isdigit()), default=-1)
        if self.overwrite:
            system, _ = opened(self.options.path)
            for name, _, _ in old:
                system.delete_file(opened(name)[1])
        self.renamed(messages, lambda k: f"{free + k:05d}.bin")

    def abort(self, messages: list[Written | None]) -> None:
        self.dropped(messages)


class StreamWriter(_Files, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, _ = opened(self.options.path)
        for name, shard, _ in files(self.options.path, ".bin"):
            if shard.startswith(f"{batchId:08d}-"):
                system.delete_file(opened(name)[1])
        self.renamed(messages, lambda k: f"{batchId:08d}-{k:05d}.bin")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.dropped(messages)


class TokenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokens"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(Options(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Options(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(Options(self.options), schema.fieldNames().index("tokens"), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(Options(self.options), schema.fieldNames().index("tokens"), overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(TokenSource)
