"""What a task holds at once does not grow with its rows."""

import io
import tarfile
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenlake.functions import images as im
from tokenlake.functions.batches import PIECE, commas, lists
from tokenlake.operators import evaluation, ngram, tokenizers
from tokenlake.plans import image_queries
from tokenlake.sources import images, token_files, token_source


def narrow():
    class Narrow:
        """A tokenizer that refuses stacks beyond a piece."""

        size, presize, vocab, tokens_per_image = 8, "lanczos", 256, 64

        def encode(self, images):
            assert images.nbytes <= PIECE and len(images) * 64 * 8 <= PIECE
            return images[..., 0].reshape(len(images), -1)

        def decode(self, tokens):
            assert len(tokens) * 64 * 8 <= PIECE
            return np.repeat(tokens.reshape(-1, 8, 8, 1), 3, -1).astype(np.uint8)

    return Narrow()  # a class of a function goes to tasks by value


@pytest.fixture(scope="module")
def many(spark):
    """More images than fit a piece, in one batch, and two broken ones."""
    data = F.expr("unhex(repeat(lpad(hex(id % 256), 2, '0'), 192))")
    good = spark.range(0, 9000, 1, 1).select(F.col("id").alias("img_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), data.alias("data"))
    return good.withColumn("data", F.when(F.col("img_id") == 5, F.lit(None)).when(F.col("img_id") == 8999, F.unhex(F.lit("00"))).otherwise(F.col("data")))


def test_tokenizers_get_pieces(many):
    coded = tokenizers.tokenize(many, narrow(), "placeholder")
    got = {r["img_id"]: (r["n"], r["least"], r["most"], r["failed"]) for r in coded.select("img_id", "failed", F.size("tokens").alias("n"), F.array_min("tokens").alias("least"), F.array_max("tokens").alias("most")).collect()}
    assert got == {i: (64, 128, 128, True) if i in (5, 8999) else (64, i % 256, i % 256, False) for i in range(9000)}
    back = tokenizers.detokenize(coded.filter("not failed"), narrow()).select("img_id", F.col("data").alias("back"))
    assert back.join(many, "img_id").filter("back = data").count() == 8998


def test_mapped_images_get_pieces(many):
    def f(x):
        assert x.nbytes <= PIECE
        return x

    kept = many.filter("img_id not in (5, 8999)")
    out = image_queries.mapped(kept, f).select("img_id", F.col("data").alias("out"))
    assert out.join(kept, "img_id").filter("out = data").count() == 8998


def test_errors_of_images_without_sending_them_to_every_task(spark, sf):
    a = image_queries.rgb(spark, sf)
    b = tokenizers.detokenize(tokenizers.tokenize(a, image_queries.COLOR), image_queries.COLOR)
    joined = evaluation.image_errors(a, b)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    once = evaluation.round_trip_errors(a, image_queries.COLOR)
    near = lambda df: {r["img_id"]: round(r["mse"], 9) for r in df.collect()}
    assert near(once) == near(joined) and len(near(once)) == a.count()
    for name in ("psnr_avg", "psnr_per_image"):
        plan = image_queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan


@pytest.fixture(scope="module")
def few_tokens(spark):
    """A stream of two tokens, in which short stretches stand everywhere, and prompts of many lengths out of it."""
    r = np.random.default_rng(4)
    docs = ["".join(r.choice(list("ab"), 300)) for _ in range(6)] + ["ab" * 40, "a"]
    rows = [(d % 2, d, p, t) for d, x in enumerate(docs) for p, t in enumerate(x)]
    asked = [docs[d][at : at + n] for d in range(6) for at, n in ((0, 3), (5, 4), (9, 7), (20, 12), (31, 30), (250, 50))] + ["b" * 25, "ab" * 12, "ba" * 20, ""]
    stream = spark.createDataFrame(rows, "shard long, doc_id long, pos int, tok string").cache()
    return docs, asked, stream, spark.createDataFrame([(i, list(x)) for i, x in enumerate(asked)], "prompt_id long, ids array<string>").cache()


@pytest.mark.parametrize("far", [2, 8, 64])
def test_long_contexts_of_any_reach(few_tokens, far):
    docs, asked, stream, prompts = few_tokens
    index = ngram.build_index(stream, 2)
    got = {r["prompt_id"]: r["cnt"] for r in ngram.count(index, prompts, stream=stream, reach=2, far=far).collect()}
    places = lambda x: [(d, i + len(x)) for d, t in enumerate(docs) for i in range(len(t) - len(x) + 1) if t.startswith(x, i)]
    assert got == {i: len(places(x)) if x else sum(map(len, docs)) for i, x in enumerate(asked)}
    want = {}
    for i, x in enumerate(asked):
        for n in range(len(x), -1, -1):
            after = [docs[d][k] for d, k in places(x[len(x) - n :]) if k < len(docs[d])] if n else list("".join(docs))
            if after:
                want |= {(i, t): (after.count(t), n) for t in set(after)}
                break
    assert {(r["prompt_id"], r["tok"]): (r["cont_cnt"], r["suffix_len"]) for r in ngram.ntd(index, prompts, stream=stream, reach=2, far=far).collect()} == want
    exact = {(i, t): v for (i, t), v in want.items() if v[1] == len(asked[i])}
    assert {(r["prompt_id"], r["tok"]): (r["cont_cnt"], r["suffix_len"]) for r in ngram.ntd(index, prompts, back_off=False, stream=stream, reach=2, far=far).collect()} == exact


def test_asked_contexts_alone_are_counted(few_tokens):
    _, _, stream, _ = few_tokens
    asked = stream.sparkSession.createDataFrame([(5, list("ababa")), (5, list("ababa")), (9, list("ababababa"))], "n int, ctx array<string>")
    rows = ngram._counts_asked(stream, asked, 3, 9).select("n", "ctx", "shard", "tok").collect()
    assert {"".join(r["ctx"]) for r in rows} == {"ababa", "ababababa"} and len(rows) == len(set(map(str, rows))) <= 2 * 2 * 2


@pytest.mark.parametrize("most", [1, 5000])
def test_tar_values_of_bounded_size(spark, sf, most):
    want = sorted(map(tuple, image_queries.q_tar_scan(spark, sf).collect()))
    assert sorted(map(tuple, image_queries._tar_bytes(spark, sf, most).collect())) == want and len(want) > 100


def test_tar_members_are_not_kept():
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for k in range(50):
            tar.addfile(tarfile.TarInfo(f"{k}.png"))
    with tarfile.open(fileobj=io.BytesIO(raw.getvalue()), mode="r:") as tar:
        assert [(m.name, len(tar.members)) for m in images.members(tar)] == [(f"{k}.png", 0) for k in range(50)]


def test_ranges_of_token_files_share_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(k % 2, k, [k % 7, 1, 2]) for k in range(400)], "shard int, doc_id long, tokens array<int>")
    token_files.write_npy(docs, f"file://{tmp_path}")
    token_source.register(spark)
    read = lambda share: spark.read.format("tokens").option("layout", "npy").option("range", 16).option("share", share).load(f"file://{tmp_path}")
    few, many = read(1 << 20), read(160)
    assert few.rdd.getNumPartitions() == 1 < many.rdd.getNumPartitions()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() == 400


def test_image_folders_are_listed_and_read_by_tasks(spark, tmp_path):
    top = tmp_path / "a b%c"
    for k in range(300):
        place = top / ("" if k % 3 == 0 else f"{k % 3}" if k % 3 == 1 else f"{k % 3}/deep=x/{k % 5}")
        place.mkdir(parents=True, exist_ok=True)
        (place / (f"{k} %25.PNG" if k % 2 else f"{k}.txt" if k % 7 == 0 else f"{k}.png")).write_bytes(bytes([k % 256]) * (k % 4))
    for hidden in ("_x.png", ".y.png", "z.png._COPYING_"):
        (top / hidden).write_bytes(b"1")
    (top / "_no").mkdir()
    (top / "_no" / "1.png").write_bytes(b"1")
    rows = lambda df: sorted((r["path"], r["length"], bytes(r["content"])) for r in df.collect())
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(top)).filter(images.is_image(F.col("path")))
    got = images.image_files(spark, str(top))
    assert rows(got) == rows(by_spark) and got.count() == 214
    assert [r["path"] for r in images.sorted_files(spark, f"file://{tmp_path}/a b%c/").collect()] == sorted(r[0] for r in rows(by_spark))
    assert images.image_paths(spark, str(top), recursive=False).count() == sum(p.suffix.lower() == ".png" and p.name[0] not in "_." and p.stat().st_size > 0 for p in top.iterdir())
    # Spark alone would take 4 MB for each file, so 32 to a task, and have all names on the driver
    assert images.image_files(spark, str(top), share=100).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert images.image_files(spark, str(top), share=10).rdd.getNumPartitions() == -(-got.count() // 10)
    assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(images.image_files(spark, f"{tmp_path}/a b%c/*/*.PNG")) == [r for r in rows(by_spark) if "c/1/" in r[0] and r[0].endswith("PNG")]
    (tmp_path / "none").mkdir()
    assert images.image_files(spark, str(tmp_path / "none")).count() == 0


def test_images_are_written_to_folders(spark, sf, tmp_path):
    done = images.write_images(image_queries.rgb(spark, sf, 2, 2), f"file://{tmp_path}/p", folder=F.expr("img_id div 50")).count()
    found = [p.relative_to(tmp_path / "p") for p in (tmp_path / "p").rglob("*.png")]
    assert len(found) == done and all(int(p.parts[0]) == int(p.stem) // 50 and len(p.parts) == 2 for p in found)


def test_numbers_of_images_get_pieces(many):
    def f(x):
        assert x.nbytes <= PIECE
        return [x[:, :2, 0, 0].astype(np.int64) - 128]

    out = image_queries.numbers(many.filter("img_id not in (5, 8999)"), f, ["two"])
    assert {r["img"]: r["two"] for r in out.collect()} == {i: f"{i % 256 - 128},{i % 256 - 128}" for i in range(9000) if i not in (5, 8999)}


def test_numbers_are_joined_without_rows_of_strings(spark, sf):
    x = np.random.default_rng(0).integers(-300, 300, (40, 17))
    want = [",".join(map(str, r)) for r in x.tolist()]
    assert commas(lists(x)).to_pylist() == want and commas(lists(x).slice(5, 7)).to_pylist() == want[5:12] and len(commas(lists(x[:0]))) == 0
    assert commas(pa.array([[], [1], []], pa.list_(pa.int32()))).to_pylist() == ["", "1", ""]
    for name in ("pyramid_residual_3lvl", "block_extract"):
        assert "array_join" not in image_queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("h", "w", "height", "width"), [(32, 32, 16, 16), (5, 7, 9, 3), (3, 150, 2, 100)])
def test_resize_by_its_definition(h, w, height, width):
    x = np.random.default_rng(h).integers(0, 256, (2, h, w, 3)).astype(np.uint8)
    byte = lambda v: min(255, max(0, int(np.floor(round(v, 9) + 0.5))))
    for kernel in ("triangle", "lanczos"):
        a, b = im.weights(w, width, kernel), im.weights(h, height, kernel)
        rows = np.array([[[[byte(sum(a[k, j] * int(x[i, y, j, c]) for j in range(w)) / a[k].sum()) for c in range(3)] for k in range(width)] for y in range(h)] for i in range(2)])
        want = [[[[byte(sum(b[k, j] * int(rows[i, j, y, c]) for j in range(h)) / b[k].sum()) for c in range(3)] for y in range(width)] for k in range(height)] for i in range(2)]
        assert im.resize(x, height, width, kernel).tolist() == want


def test_narrow_weights_alone_are_spread_over_channels():
    im._spread.cache_clear()
    im.resize(np.zeros((1, 4, 3000, 3), np.uint8), 4, 1000)
    assert im._spread.cache_info().currsize == 0


class Local:
    """A table that is one Arrow batch: functions of batches run here, what they yield is copied away as Spark does, and becomes one batch again."""

    def __init__(self, batch, dtypes, peaks):
        self.batch, self.dtypes, self.peaks = batch, dtypes, peaks

    def select(self, *columns):
        return self  # steps take columns by place

    def mapInArrow(self, run, schema):
        sink, writer = pa.BufferOutputStream(), None
        tracemalloc.start()
        for out in run(iter([self.batch])):
            writer = writer or pa.ipc.new_stream(sink, out.schema)
            writer.write_batch(out)
            del out
        self.peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        writer.close()
        (whole,) = pa.ipc.open_stream(sink.getvalue()).read_all().combine_chunks().to_batches()
        return Local(whole, [tuple(x.split()) for x in schema.replace("`", "").split(", ")], self.peaks)


@pytest.mark.parametrize("name", ["tensor_images", "dct_decode", "haar_decode"])
def test_steps_hold_no_more_for_more_images(spark, sf, name, monkeypatch):
    def images_of(n):
        rows = [bytes([i % 256]) * 3072 for i in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), *[pa.array([32] * n, pa.int32())] * 2, pa.array(rows, pa.binary())], ["img_id", "height", "width", "data"])
        return Local(batch, [("img_id", "bigint"), ("data", "binary")], [])

    monkeypatch.setattr(image_queries, "pixels", lambda x: x)
    held = []
    for n in (2000, 8000):
        monkeypatch.setattr(image_queries, "rgb", lambda spark, sf, made=images_of(n): made)
        out = image_queries.queries()[name](spark, sf)
        assert len(out.peaks) == 2 and out.batch.column(0).to_pylist() == list(range(n))
        if name == "tensor_images":
            assert out.batch.column(3).to_pylist() == [bytes([i % 256]) * 3072 for i in range(n)]
        held.append(max(out.peaks))
    assert held[1] < 1.2 * held[0] and held[1] < 48 * PIECE


def test_batches_of_tasks_are_of_bounded_size(spark):
    """What a step gets at once: planes of 6,000 images are 147 MB, a batch is Spark's 64 MB and a row at most."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    got = spark.range(0, 6000, 1, 1).select(F.array_repeat(F.rand(1), 3072).alias("planes")).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 6000 and len(got) >= 3 and max(r["size"] for r in got) <= (64 << 20) + 2 * 3072 * 8
