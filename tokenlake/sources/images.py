"""Images from folders, tar shards, Parquet and bytes, as rows (img_id or path, height, width, data), and image files from rows."""

from __future__ import annotations

import io
import itertools
import os
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions.batches import PIECE, pieces
from tokenlake.functions.images import denormalise
from tokenlake.functions.storage import written
from tokenlake.sources.token_files import opened

#: File name endings of images.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "tga", "psd", "hdr", "pic")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def shard_names(template: str, first: int, count: int, n: int) -> list[str]:
    """The names of shards, from a template with the shard's number i and their number n, such as "{i:05d}.tar"."""
    return [template.format(i=i, n=n) for i in range(first, min(first + count, n))]


def _by_spark(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.filter(is_image(F.col("path")))


def _root(spark: SparkSession, folder: str) -> tuple[str, str] | None:
    """A folder's path as Spark writes it and its URI; None of patterns, files and stores that Arrow cannot open."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    root, uri = path.toString(), path.toUri().toString()
    try:
        system, place = opened(uri)
        return (root, uri) if system.get_file_info(place).type == fs.FileType.Directory and not root.endswith("/") else None
    except (OSError, ValueError, NotImplementedError):
        return None


def _entries(system: fs.FileSystem, place: str) -> Iterator[tuple[str, int | None]]:
    """(name, bytes) of what is in a folder, bytes None of folders; names that Spark passes over are left out."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(place) as found:  # one by one, so a folder may hold any number
            for x in found:
                if seen(x.name) and os.path.exists(x.path):
                    yield x.name, None if x.is_dir() else x.stat().st_size
    else:
        for x in system.get_file_info(fs.FileSelector(place)):
            if seen(x.base_name):
                yield x.base_name, None if x.type == fs.FileType.Directory else x.size


def seen(name: str) -> bool:
    return not (name[0] == "." or (name[0] == "_" and "=" not in name) or name.endswith("._COPYING_"))


def _listed(spark: SparkSession, root: str, uri: str, recursive: bool) -> DataFrame:
    """(path, length) of all files of a folder but empty ones, which Spark passes over too: tasks list the folders of one depth, then those of the next, and the driver has no names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(uri)
        for batch in batches:
            found = ((f"{path}/{name}", n) for path in batch.column(0).to_pylist() for name, n in _entries(system, base + path[len(root) :]))
            while rows := list(itertools.islice(found, 5000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64()), strict=True)], ["path", "length"])

    folders, out = spark.createDataFrame([(root,)], "path string"), None
    while True:
        found = written(folders.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(run, "path string, length long"), "listed")
        files = found.filter("length > 0")
        out = files if out is None else out.unionByName(files)
        folders = found.filter("length is null").select("path")
        if not recursive or folders.isEmpty():
            return out


def image_paths(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length) of image files, listed by tasks; by Spark, with all names on the driver, only of patterns and stores that Arrow cannot open."""
    at = _root(spark, folder)
    files = _listed(spark, *at, recursive) if at else _by_spark(spark, folder, recursive)
    return files.filter(is_image(F.col("path"))).select("path", "length")


def image_files(spark: SparkSession, folder: str, recursive: bool = True, share: int = 4096) -> DataFrame:
    """(path, length, content) of image files; the ending is tested before any content is read.

    Listed as by image_paths, then read in tasks of about `share` files each, however small they are.
    """
    at = _root(spark, folder)
    if not at:
        return _by_spark(spark, folder, recursive).select("path", "length", "content")
    root, uri = at
    files = image_paths(spark, folder, recursive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(uri)
        for batch in batches:
            rows, held, kinds = [], 0, [pa.string(), pa.int64(), pa.binary()]
            for k, (path, length) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True), 1):
                with system.open_input_file(base + path[len(root) :]) as file:
                    rows.append((path, length, file.readall()))
                held += length
                if held >= PIECE or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "length", "content"])
                    rows, held = [], 0

    tasks = max(spark.sparkContext.defaultParallelism, -(-files.count() // share))
    return files.repartition(tasks, "path").mapInArrow(run, "path string, length long, content binary")


def sorted_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length) of image files in the order of their paths; contents are not read."""
    return image_paths(spark, folder, recursive).orderBy("path")


def sample_paths(files: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, those whose paths have the least digests; all if there are fewer."""
    return files.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("path"))), "path").limit(n)


def folder_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, data): decoded by Spark's image source, which is BGR; grey is repeated, alpha dropped, bad files go."""
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(folder).select("image.*")

    def rgb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4):
            out = []
            for h, w, c, data in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c)
                out.append((np.repeat(x, 3, 2) if c == 1 else x[:, :, 2::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["path", "height", "width", "data"])

    return raw.select("origin", "height", "width", "nChannels", "data").mapInArrow(rgb, "path string, height int, width int, data binary")


@cache
def pillow():
    """Pillow's Image if it is there, looked for once: a search that finds nothing costs more than a small image."""
    try:
        from PIL import Image
    except ImportError:
        return None
    return Image


def decode(raw: bytes | None) -> np.ndarray | None:
    """uint8[h, w, 3] of whatever Pillow reads if it is there; without it of PNG bytes and binary PPM; else None."""
    if not raw:
        return None
    try:
        if pillow() is not None:
            return np.array(pillow().open(io.BytesIO(raw)).convert("RGB"))
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw[:2] == b"P6":
            parts = raw.split(None, 4)
            w, h = int(parts[1]), int(parts[2])
            return np.frombuffer(raw[-w * h * 3 :], np.uint8).reshape(h, w, 3)
        return None
    except (ValueError, KeyError, IndexError, struct.error, zlib.error, OSError, SyntaxError):
        return None


#: First row, first column, row step and column step of the seven interlace passes.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _png(raw: bytes) -> np.ndarray:
    at, packed, palette = 8, [], None
    w = h = depth = kind = interlaced = 0
    while at < len(raw):
        (n,), name = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + n]
        at += 12 + n
        if name == b"IHDR":
            w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    data = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    out, at = np.zeros((h, w, channels), np.uint16), 0
    for top, left, down, across in PASSES if interlaced else ((0, 0, 1, 1),):
        height, width = -(-max(h - top, 0) // down), -(-max(w - left, 0) // across)
        if not height or not width:
            continue
        row = -(-width * channels * depth // 8)
        lines = unfiltered(data[at : at + height * (row + 1)].reshape(height, row + 1), max(1, channels * depth // 8))
        at += height * (row + 1)
        if depth == 16:
            values = lines.view(">u2")
        elif depth == 8:
            values = lines
        else:
            bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
            values = bits @ (1 << np.arange(depth)[::-1])
        out[top::down, left::across] = values[:, : width * channels].reshape(height, width, channels)
    if kind == 3:
        return palette[out[:, :, 0]]
    if depth == 16:
        out = out >> 8
    elif depth < 8:
        out = out * (255 // ((1 << depth) - 1))
    out = out.astype(np.uint8)
    return np.repeat(out[:, :, :1], 3, 2) if channels < 3 else out[:, :, :3]


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """The bytes of PNG lines, each after its filter's number; step: bytes of a pixel.

    Up and none need no loop over pixels, and sub is a running sum; the others go along a line pixel by pixel.
    """
    modes, out = lines[:, 0], lines[:, 1:].copy()
    n = out.shape[1]
    above = np.zeros(n, np.uint8)
    for y, mode in enumerate(modes.tolist()):
        line = out[y]
        if mode == 1:
            whole = np.zeros(-(-n // step) * step, np.uint8)
            whole[:n] = line
            line[:] = np.cumsum(whole.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)[:n]
        elif mode == 2:
            line += above
        elif mode in (3, 4):
            values, up = line.tolist(), above.tolist()
            if mode == 3:
                for x in range(n):
                    values[x] = (values[x] + ((values[x - step] if x >= step else 0) + up[x]) // 2) & 255
            else:
                for x in range(n):
                    a, b, c = (values[x - step], up[x], up[x - step]) if x >= step else (0, up[x], 0)
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    values[x] = (values[x] + (a if p <= q and p <= r else b if q <= r else c)) & 255
            line[:] = values
        elif mode:
            raise ValueError("an unknown filter")
        above = line
    return out


def encode_png(image: np.ndarray) -> bytes:
    """PNG bytes of uint8[h, w, 3], or of grey uint8[h, w]."""
    h, w = image.shape[:2]
    kind = 2 if image.ndim == 3 else 0
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], 1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def encoded(images: DataFrame, key: str, grey: bool = False) -> DataFrame:
    """(key, png) of images(key, height, width, data); grey: of the first channel alone. Null data stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            out = []
            for h, w, data in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                x = None if data is None else np.frombuffer(data, np.uint8).reshape(h, w, 3)
                out.append(None if x is None else encode_png(x[:, :, 0] if grey else x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "png"])

    kind = dict(images.dtypes)[key]
    return images.select(key, "height", "width", "data").mapInArrow(run, f"`{key}` {kind}, png binary")


def decoded(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, height, width, data) of encoded images; what cannot be read has null data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.binary()]
        for batch in pieces(batches, 1):
            # files are small beside their pixels, so these are counted as they come
            rows, at, held = [], 0, 0
            for k, raw in enumerate(batch.column(1).to_pylist(), 1):
                x = decode(raw)
                rows.append((None, None, None) if x is None else (*x.shape[:2], x.tobytes()))
                held += 0 if x is None else x.nbytes
                if held >= PIECE or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, k - at), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [key, "height", "width", "data"])
                    rows, at, held = [], k, 0

    kind = dict(rows.dtypes)[key]
    return rows.select(key, content).mapInArrow(run, f"`{key}` {kind}, height int, width int, data binary")


def members(tar: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """The members of a tar in their order, which it does not keep."""
    while (m := tar.next()) is not None:
        tar.members = []
        yield m


def tar_index(spark: SparkSession, paths: str | list[str], endings: tuple[str, ...] = ("jpg", "jpeg", "png"), first: int | None = None, count: int | None = None) -> DataFrame:
    """(path, shard, member_idx, name, at, size) of the images in tar shards, members in their order; only headers are read.

    first and count choose shards by their number, the digits that end a shard's name, before anything is read.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    number = F.regexp_extract("path", r"(\d+)\.tar$", 1).cast("int")
    if first is not None:
        files = files.filter((number >= first) & (number < first + (count or 1)))
    name = F.regexp_extract("path", r"([^/]+)\.tar$", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for path, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = opened(path)
                with system.open_input_file(place) as file, tarfile.open(fileobj=file, mode="r:") as tar:
                    found = enumerate(x for x in members(tar) if x.isfile() and x.name.lower().rsplit(".", 1)[-1] in endings)
                    while rows := [(path, shard, k, m.name, m.offset_data, m.size) for k, m in itertools.islice(found, 5000)]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "shard", "member_idx", "name", "at", "size"])

    # a task for each shard: headers stand all over it
    named = files.select("path", name.alias("shard"))
    return named.repartition("path").mapInArrow(run, "path string, shard string, member_idx int, name string, at long, size long")


def tar_members(spark: SparkSession, paths: str | list[str], endings: tuple[str, ...] = ("jpg", "jpeg", "png"), first: int | None = None, count: int | None = None, batch_bytes: int = 8 << 20) -> DataFrame:
    """(shard, member_idx, name, bytes) of tar shards, members in their order.

    Members are listed first, then read by their places in many tasks, batch_bytes at a time, so a shard may be of any size.
    """
    listed = tar_index(spark, paths, endings, first, count)
    slices = listed.repartition("path", F.floor(F.col("at") / (batch_bytes * 8))).sortWithinPartitions("path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.binary()]
        for batch in batches:
            rows, size, last, file = [], 0, None, None
            for path, shard, k, name, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != last:
                    if file is not None:
                        file.close()
                    system, place = opened(path)
                    last, file = path, system.open_input_file(place)
                rows.append((shard, k, name, file.read_at(length, at)))
                size += length
                if size >= batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "member_idx", "name", "bytes"])
                    rows, size = [], 0
            if file is not None:
                file.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "member_idx", "name", "bytes"])

    return slices.mapInArrow(run, "shard string, member_idx int, name string, bytes binary")


def tar_bytes_members(rows: DataFrame, shard: str, content: str, endings: tuple[str, ...] = ("jpg", "png")) -> DataFrame:
    """(shard, member_idx, name, bytes) of tars that are values of a column; a null or broken tar has no members, or those before the break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.binary()]
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, held, k = [], 0, 0
                done = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "member_idx", "name", "bytes"])
                try:
                    # the value is read where Arrow has it, and members go as soon as there are enough
                    with tarfile.open(fileobj=pa.BufferReader(raw.as_buffer() or pa.py_buffer(b"")), mode="r:") as tar:
                        for m in members(tar):
                            if m.isfile() and m.name.lower().rsplit(".", 1)[-1] in endings:
                                out.append((key, k, m.name, tar.extractfile(m).read()))
                                held, k = held + m.size, k + 1
                                if held >= PIECE:
                                    yield done(out)
                                    out, held = [], 0
                except tarfile.TarError:
                    pass
                if out:
                    yield done(out)

    return rows.select(F.col(shard).cast("string").alias("shard"), content).mapInArrow(run, "shard string, member_idx int, name string, bytes binary")


def write_tars(members: DataFrame, uri: str, most: int | None = None) -> DataFrame:
    """Write members(shard, member_idx, name, bytes) as <uri>/<shard>.tar, streamed; (shard, members) of what was written.

    most: bytes of content after which a shard goes on in a further file, <uri>/<shard>-<members before it>.tar, the first too, so
    that a file can be a value of a column; a row for each file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(uri)
        system.create_dir(path)
        now = sink = tar = part = None
        count = before = held = 0

        def close() -> pa.RecordBatch:
            tar.close()
            sink.close()
            system.move(part, f"{path}/{now:05d}.tar" if most is None else f"{path}/{now:05d}-{before:09d}.tar")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([count], pa.int64())], ["shard", "members"])

        for batch in batches:
            for shard, name, raw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if shard != now or (most is not None and held >= most):
                    if tar is not None:
                        yield close()
                    before = before + count if shard == now else 0
                    now, count, held, part = shard, 0, 0, f"{path}/{uuid.uuid4().hex}.tmp"
                    sink = system.open_output_stream(part)
                    tar = tarfile.open(fileobj=sink, mode="w|")
                info = tarfile.TarInfo(name)
                info.size = len(raw)
                tar.addfile(info, io.BytesIO(raw))
                tar.members = []  # or it keeps all
                count, held = count + 1, held + len(raw)
        if tar is not None:
            yield close()

    keyed = members.select(F.col("shard").cast("long").alias("shard"), "member_idx", "name", "bytes")
    return written(keyed.repartition("shard").sortWithinPartitions("shard", "member_idx").mapInArrow(run, "shard long, members long"), "tars")


def write_images(images: DataFrame, uri: str, name: str = "img_id", folder: Column | None = None) -> DataFrame:
    """Write images(name, height, width, data) as <uri>/<name>.png; (path, bytes) of what was written. Null data gives no file.

    folder: a folder of each image, <uri>/<folder>/<name>.png, so that no folder need hold all files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(uri)
        system.create_dir(top)
        made = {top}
        for batch in pieces(batches, 3):
            done = []
            for key, h, w, data, sub in zip(*(batch.column(k) for k in range(5)), strict=True):
                if data.is_valid:
                    raw = encode_png(np.frombuffer(data.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), 3))
                    path = f"{top}/{sub.as_py()}" if sub.is_valid else top
                    if path not in made:
                        system.create_dir(path)
                        made.add(path)
                    part, place = f"{path}/{uuid.uuid4().hex}.tmp", f"{path}/{key.as_py()}.png"
                    with system.open_output_stream(part) as sink:
                        sink.write(raw)
                    system.move(part, place)
                    done.append((place, len(raw)))
            cols = list(zip(*done, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], ["path", "bytes"])

    into = F.lit(None).cast("string") if folder is None else folder.cast("string")
    return written(images.select(name, "height", "width", "data", into.alias("folder")).mapInArrow(run, "path string, bytes long"), "images")


def tensor_images(rows: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """(key, height, width, data) of rows(key, planes): channel-first numbers in [-1, 1], cut to bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            n = batch.num_rows
            planes = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, 3, height, width)
            data = [x.tobytes() for x in denormalise(planes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([height] * n, pa.int32()), pa.array([width] * n, pa.int32()), pa.array(data, pa.binary())], [key, "height", "width", "data"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "planes").mapInArrow(run, f"`{key}` {kind}, height int, width int, data binary")


def parquet_images(spark: SparkSession, path: str) -> DataFrame:
    """(bytes) of a Parquet dataset with image structs; only that field is read."""
    return spark.read.parquet(path).select(F.col("image.bytes").alias("bytes"))
