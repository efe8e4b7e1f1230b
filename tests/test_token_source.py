"""The data source of token files keeps what it is given."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenlake.operators import stream
from tokenlake.sources import token_files, token_source


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def flat(path, docs, tail=b""):
    raw = b"".join(np.array([*d, 65535], "<u2").tobytes() for d in docs) + tail
    with open(path, "wb") as f:
        f.write(raw)


@pytest.mark.parametrize("size", [2, 6, 10, 64, 1 << 20])
def test_source_reads_each_document_once(spark, tmp_path, size):
    """Whatever the ranges: empty documents, documents over many ranges, ends at a range's end, a tail without separator."""
    docs = [[], [1], [2, 3], list(range(100)), [], [], [7] * 4, [8]]
    flat(f"{tmp_path}/a.bin", docs, np.array([5, 5, 5], "<u2").tobytes())
    flat(f"{tmp_path}/b.bin", [], b"\x01")
    flat(f"{tmp_path}/c.bin", [[4]])
    open(f"{tmp_path}/.d.bin", "wb").write(b"\xff\xff")
    token_source.register(spark)
    got = told(spark.read.format("tokens").option("range", size).load(str(tmp_path)))
    starts = np.cumsum([0] + [len(d) + 1 for d in docs]).tolist()
    assert got == sorted([("a", s, d) for s, d in zip(starts, docs, strict=False)] + [("c", 0, [4])], key=str)
    assert told(spark.read.format("tokens").load(f"{tmp_path}/c.bin")) == [("c", 0, [4])]


def test_source_layouts(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.integers(0, 65535, (50, 4))
    np.save(f"{tmp_path}/n.npy", x.astype("<u4"))
    open(f"{tmp_path}/h.bin", "wb").write(token_files.headered(x.tolist()))
    token_source.register(spark)
    for layout, shard in (("npy", "n"), ("headered", "h")):
        got = spark.read.format("tokens").option("layout", layout).option("range", 40).load(str(tmp_path))
        assert sorted(map(tuple, got.collect())) == [(shard, 4 * i, row) for i, row in enumerate(x.tolist())]
    with pytest.raises(Exception, match="layout"):
        spark.read.format("tokens").option("layout", "other").load(str(tmp_path)).collect()


def test_source_opens_named_files_only(spark, tmp_path):
    """The header of one that is not named would be an error."""
    open(f"{tmp_path}/bad.bin", "wb").write(b"x")
    open(f"{tmp_path}/good.bin", "wb").write(token_files.headered([[1, 2]]))
    token_source.register(spark)
    read = spark.read.format("tokens").option("layout", "headered")
    assert told(read.option("shards", "good, none").load(str(tmp_path))) == [("good", 0, [1, 2])]
    with pytest.raises(Exception):  # noqa: B017
        read.option("shards", "").load(str(tmp_path)).collect()


def test_conditions_do_not_outlive_their_query(spark, tmp_path):
    for name in "abc":
        flat(f"{tmp_path}/{name}.bin", [[1], [2]])
    token_source.register(spark)
    read = spark.read.format("tokens").load(str(tmp_path))
    assert [read.filter("shard = 'a'").count(), read.count(), read.filter("shard = 'b'").count()] == [2, 6, 2]


def test_source_writes(spark, tmp_path):
    token_source.register(spark)
    path = str(tmp_path / "out")
    docs = spark.createDataFrame([(i, [i, i + 1] * (i % 4)) for i in range(40)], "k long, tokens array<int>").repartition(3)
    docs.write.format("tokens").mode("append").save(path)
    docs.limit(5).coalesce(1).write.format("tokens").mode("append").save(path)
    read = spark.read.format("tokens").load(path)
    assert read.count() == 45 and len(os.listdir(path)) == 4
    want = sorted(map(str, [r["tokens"] for r in docs.collect()]))
    docs.write.format("tokens").mode("overwrite").save(path)
    assert sorted(str(r["tokens"]) for r in spark.read.format("tokens").load(path).collect()) == want
    with pytest.raises(Exception):  # noqa: B017
        docs.unionByName(spark.createDataFrame([(0, [65535])], "k long, tokens array<int>")).write.format("tokens").mode("append").save(path)
    assert spark.read.format("tokens").load(path).count() == 40 and not [x for x in os.listdir(path) if x.endswith(".tmp") and not x.startswith(".")]
    assert token_files.read_flat(spark, f"{path}/*.bin").count() == 40


def test_source_stream_takes_new_files_once(spark, tmp_path):
    token_source.register(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(source)

    def go():
        arriving = spark.readStream.format("tokens").load(source)
        query = arriving.writeStream.format("tokens").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return sorted(r["tokens"] for r in spark.read.format("tokens").load(out).collect())

    flat(f"{source}/00000.bin", [[1], [2, 2]])
    assert go() == [[1], [2, 2]]
    assert go() == [[1], [2, 2]]
    flat(f"{source}/00001.bin", [[3]])
    flat(f"{source}/00002.bin", [])
    assert go() == [[1], [2, 2], [3]]


def test_flat_source_of_a_stream_of_tokens(spark, tmp_path):
    """What stream.flatten makes and what the source reads are one."""
    token_source.register(spark)
    docs = spark.createDataFrame([(0, i, list(range(i))) for i in range(6)], "shard int, doc_id long, tokens array<int>")
    token_files.write_flat(docs, f"file://{tmp_path}/x")
    long = stream.flatten(docs, token_files.SEPARATOR)
    read = spark.read.format("tokens").load(f"file://{tmp_path}/x")
    assert long.count() == read.select(F.sum(F.size("tokens") + 1)).first()[0]
