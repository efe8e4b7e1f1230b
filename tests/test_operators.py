"""Closed forms, round trips and metamorphic checks of the operators that queries only touch in part."""

import io
import itertools
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenlake import cli
from tokenlake.functions import images as im
from tokenlake.operators import codebook, evaluation, ngram, sampling, stream, tokenizers
from tokenlake.plans import text_queries
from tokenlake.sources import images, token_files
from tokenlake.streaming import tokens as streaming

#: Tokens per image by preset.
SIZES = {
    "dct-tiny": 256, "dct-small": 768, "dct-medium": 3072, "dct-large": 49152, "haar-tiny": 48, "haar-small": 192, "haar-medium": 768, "haar-large": 12288,
    "pyramid-tiny": 240, "pyramid-small": 960, "pyramid-medium": 4032, "pyramid-large": 16128, "residual-2": 960, "residual-3": 4032, "residual-4": 16320,
    "residual-5": 65472, "residual-6": 65520, "color-tiny": 64, "color-small": 256, "color-medium": 1024, "color-large": 4096,
}


@pytest.mark.parametrize("name", sorted(tokenizers.PRESETS))
def test_presets(name):
    t, image = tokenizers.PRESETS[name], im.gradient()
    tokens = t.encode(image)
    assert tokens.shape == (1, t.tokens_per_image) and t.tokens_per_image == SIZES.get(name, t.tokens_per_image)
    assert tokens.min() >= 0 and tokens.max() < t.vocab
    back = t.decode(tokens)
    assert back.shape == image.shape
    if name.startswith(("dct-small", "dct-medium", "dct-large", "haar-s", "haar-m", "haar-l", "pyramid", "residual", "color")):
        assert im.psnr(image, back)[0] > 25


def test_transforms_invert():
    x = np.random.default_rng(1).normal(size=(3, 2, 16, 16))
    for n in (8, 16, 32):
        b = im.dct_basis(n)
        assert np.allclose(b @ b.T, np.eye(n)) and sorted(im.zigzag(n)) == list(range(n * n))
    assert im.zigzag(8)[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert np.allclose(im.unhaar(im.haar(x, 4)), x)
    image = np.random.default_rng(2).integers(0, 256, (2, 32, 32, 3)).astype(np.uint8)
    assert (im.from_blocks(im.to_blocks(image, 8)) == image).all()
    assert np.abs(im.to_rgb(im.to_ycbcr(image)).astype(int) - image).max() <= 1
    assert (im.denormalise(im.normalise(image)).astype(int) - image >= -1).all()
    flat = np.full((1, 40, 60, 3), 77, np.uint8)
    for kernel in im.KERNELS:
        assert (im.resize_crop(flat, 16, kernel) == 77).all()


def test_closed_loop_residuals_are_exact_unless_clipped():
    image = im.gradient(32)
    t = tokenizers.Pyramid((8, 16, 32), True, size=32, output=32)
    assert (t.decode(t.encode(image)) == image).all()


def test_vector_quantisers():
    image = np.random.default_rng(3).integers(0, 256, (2, 32, 32, 3)).astype(np.uint8)
    book = im.to_blocks(image, 8).reshape(-1, 192).astype(float)
    t = tokenizers.Vq(book, size=32)
    assert t.block == 8 and (t.decode(t.encode(image)) == image).all()
    h = tokenizers.HierarchicalVq((tokenizers.Vq(tokenizers.grid_codebook(27, 16), size=32), t))
    assert h.encode(image).shape == (2, 4 + 16) and (h.decode(h.encode(image)) == image).all()


def test_tokenize_policies(spark):
    good = im.gradient(32)[0].tobytes()
    rows = spark.createDataFrame([(1, 32, 32, bytearray(good)), (2, 32, 32, bytearray(b"short")), (3, 32, 32, None)], "img_id long, height int, width int, data binary")
    t = tokenizers.Color(32, 8, 3)
    assert [r["img_id"] for r in tokenizers.tokenize(rows, t).collect()] == [1]
    kept = {r["img_id"]: r for r in tokenizers.tokenize(rows, t, "placeholder").collect()}
    assert kept[2]["failed"] and kept[3]["tokens"] == [128] * 16 and not kept[1]["failed"]
    assert tokenizers.detokenize(tokenizers.tokenize(rows, t), tokenizers.Color(32, 16, 3)).count() == 0


def test_codebook(spark):
    r = np.random.default_rng(4)
    data = np.concatenate([r.normal(c, 0.1, (60, 3)) for c in (-3, 0, 5)])
    vectors = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(data)], "vec_id long, v array<double>")
    book = codebook.fit(vectors, 3, 8, seed=2)
    first, error = codebook.update(vectors, book)
    assert error <= codebook.update(vectors, codebook.initial(vectors, 3, 2))[1] and book.shape == first.shape
    far = np.concatenate([book, np.full((1, 3), 1e6)])
    assert codebook.update(vectors, far)[0][3].max() < 10  # the unused code is drawn anew
    lone, more = np.concatenate([book, np.full((1, 3), 99.0)]), vectors.unionByName(spark.createDataFrame([(999, [100.0] * 3)], vectors.schema))
    assert np.allclose(codebook.update(more, lone)[0][3], 100)  # a code of one vector stays by default
    assert codebook.update(more, lone, reseed_below=2, seed=3)[0][3].max() < 10
    small = codebook.fit_batches(vectors, 3, batch=60, steps=6)
    assert sorted(np.round(small.mean(1)).tolist()) == [-3, 0, 5]
    assert codebook.fit_batches(vectors.limit(0), 3).shape == (0, 0)
    assert codebook.sample_vectors(vectors, 7, 1).collect() == codebook.sample_vectors(vectors.repartition(3), 7, 1).collect()


def test_codebooks_from_images(spark):
    r = np.random.default_rng(5)
    images_ = [(k, 32, 32, bytearray(r.integers(0, 256, (32, 32, 3)).astype(np.uint8).tobytes())) for k in range(6)]
    df = spark.createDataFrame([*images_, (9, 32, 32, None), (10, 32, 32, bytearray(b"short")), (11, 16, 24, bytearray(im.gradient(24)[0, :16].tobytes()))], "img_id long, height int, width int, data binary")
    got = {x["vec_id"]: x["v"] for x in codebook.blocks(df, 16, 32).collect()}
    assert sorted(got) == [k * 4 + b for k in (*range(6), 11) for b in range(4)]
    whole = np.frombuffer(bytes(images_[2][3]), np.uint8).reshape(1, 32, 32, 3)
    assert got[11] == im.to_blocks(whole, 16)[0, 3].reshape(-1).tolist()
    vq = codebook.preset(df, "tiny", size=32, iterations=2)
    assert vq.block == 32 and vq.decode(vq.encode(whole)).shape == whole.shape
    hvq = codebook.hierarchical_preset(df, "small", size=32)
    assert [v.block for v in hvq.levels] == [32, 16] and hvq.encode(whole).shape == (1, 1 + 4)


def test_ngram_identities(spark, sf):
    index = text_queries.index(spark, sf, 3).cache()
    asked = text_queries.prompts(spark)
    whole = {(r["prompt_id"], r["tok"]): r["cont_cnt"] for r in ngram.ntd(index, asked).collect()}
    for group in (1, 2, 3):
        assert whole == {(r["prompt_id"], r["tok"]): r["cont_cnt"] for r in ngram.ntd(index, asked, group=group).collect()}
    total = ngram.ntd(index, asked).groupBy("prompt_id").agg(F.sum("prob").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in total)
    # what follows a context sums to the context's own occurrences but those at a document's end
    sums = index.filter("n = 1").groupBy(F.col("ctx")[0].alias("tok")).agg(F.sum("cnt").alias("after"))
    own = index.filter("n = 0").groupBy("tok").agg(F.sum("cnt").alias("cnt"))
    docs = text_queries.events(spark, sf).select("doc_id").distinct().count()
    assert own.agg(F.sum("cnt")).first()[0] - sums.agg(F.sum("after")).first()[0] == docs


def test_flatten_then_split_is_the_identity(spark, sf):
    a = text_queries.q_split_stream(spark, sf)
    b = text_queries.turns(spark, sf)
    assert a.count() == b.count()
    tail = spark.createDataFrame([(0, i, t) for i, t in enumerate("ab|c|d")], "shard long, at long, tok string")
    assert [r["tok"] for r in stream.split_flat(tail, "|").orderBy("doc", "pos").collect()] == ["a", "b", "c"]
    assert stream.split_flat(tail, "|", keep_tail=True).count() == 4
    for width in (1, 2, 3):
        same = stream.split_flat(tail, "|", keep_tail=True, width=width).orderBy("doc", "pos").collect()
        assert same == stream.split_flat(tail, "|", keep_tail=True).orderBy("doc", "pos").collect()


def test_sampling_is_reproducible_and_stays_in_the_top(spark, sf):
    a, b = (sorted(map(tuple, text_queries.q_backoff_generate(spark, sf).collect())) for _ in range(2))
    assert a == b and all(len(t.split()) == 5 for _, t in a)
    dist = spark.createDataFrame([("c", t, p) for t, p in zip("abcd", (0.4, 0.3, 0.2, 0.1), strict=True)], "ctx string, tok string, prob double")
    x = sampling.top_k(sampling.temperature(dist, ["ctx"], 0.5), ["ctx"], 2)
    y = sampling.temperature(sampling.top_k(dist, ["ctx"], 2), ["ctx"], 0.5)
    assert [(r["tok"], round(r["prob"], 6)) for r in x.orderBy("tok").collect()] == [(r["tok"], round(r["prob"], 6)) for r in y.orderBy("tok").collect()]


def test_images_from_tar_folder_and_parquet(spark, tmp_path):
    image = im.gradient(16)[0]
    png = images.encode_png(image)
    assert (images.decode(png) == image).all() and images.decode(b"nonsense") is None and images.decode(None) is None
    for shard in (0, 1):
        with tarfile.open(tmp_path / f"{shard:05d}.tar", "w") as tar:
            for name, body in (("a.png", png), ("a.json", b"{}"), ("b.PNG", b"broken")):
                info = tarfile.TarInfo(name)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
    members = images.tar_members(spark, str(tmp_path / "*.tar"))
    assert sorted((r["shard"], r["member_idx"], r["name"]) for r in members.collect()) == [(s, k, n) for s in ("00000", "00001") for k, n in ((0, "a.png"), (1, "b.PNG"))]
    assert images.tar_members(spark, str(tmp_path / "*.tar"), first=1, count=1).count() == 2
    got = images.decoded(members, "name", "bytes").filter("data is not null").collect()
    assert len(got) == 2 and bytes(got[0]["data"]) == image.tobytes()
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics" / "x.png").write_bytes(png)
    (tmp_path / "pics" / "y.txt").write_bytes(b"text")
    assert images.image_files(spark, str(tmp_path / "pics")).count() == 1
    (row,) = images.folder_images(spark, str(tmp_path / "pics")).collect()
    assert bytes(row["data"]) == image.tobytes()
    spark.createDataFrame([((bytearray(png), "p"),)], "image struct<bytes: binary, path: string>").write.parquet(str(tmp_path / "pq"))
    assert images.parquet_images(spark, str(tmp_path / "pq")).columns == ["bytes"]


def test_token_files(spark, tmp_path):
    docs = [(k % 2, k, [k, k + 1, 65534]) for k in range(5)]
    written = token_files.write_flat(spark.createDataFrame(docs, "shard long, doc_id long, tokens array<int>"), f"file://{tmp_path}/flat")
    assert sorted(map(tuple, written.collect())) == [(0, 3, 24), (1, 2, 16)]
    back = token_files.read_flat(spark, f"{tmp_path}/flat/*.bin").collect()
    assert sorted((int(r["shard"]), r["tokens"]) for r in back) == sorted((s, t) for s, _, t in docs)
    assert {r["docs"] for r in token_files.documents_in(spark, f"{tmp_path}/flat/*.bin", 3).collect()} == {2, 3}
    (tmp_path / "h.bin").write_bytes(token_files.headered([[1, 2], [3, 4]]) + b"\x05\x00")
    assert [r["tokens"] for r in token_files.read_headered(spark, f"{tmp_path}/h.bin").collect()] == [[1, 2], [3, 4]]
    token_files.write_config(spark, f"{tmp_path}/config", vocab_size=256, separator_token=65535)
    assert token_files.read_config(spark, f"{tmp_path}/config") == {"vocab_size": 256, "separator_token": 65535}


def test_index_files(spark, sf, tmp_path):
    index = text_queries.index(spark, sf, 1)
    token_files.write_index(index, f"{tmp_path}/index")
    token_files.write_index(index.limit(1), f"{tmp_path}/index")  # what is there stays
    assert token_files.read_index(spark, f"{tmp_path}/index").count() == index.count()
    assert token_files.read_index(spark, f"{tmp_path}/index", 1, 2).select("shard").distinct().count() == 2


def test_tokenize_stream(spark, tmp_path):
    rows = [(k, 32, 32, bytearray(im.gradient(32)[0].tobytes())) for k in range(3)]
    spark.createDataFrame(rows, "img_id long, height int, width int, data binary").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a restart adds nothing
        query = streaming.tokenize_stream(streaming.file_stream(spark, f"{tmp_path}/in"), tokenizers.Color(32, 8, 3), f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_contexts_do_not_depend_on_ranges(spark, sf):
    tokens = stream.words(spark.read.parquet(f"{sf}/documents.parquet").limit(20))
    key = ["doc_id", "pos"]
    whole = ngram.contexts(tokens, 4, width=1 << 30).orderBy(*key).collect()
    assert whole and ngram.contexts(tokens, 4, width=5).orderBy(*key).collect() == whole
    assert ngram.contexts(tokens, 4, width=1).orderBy(*key).collect() == whole


def test_places_do_not_depend_on_buckets(spark):
    rows = [(d, at, at // 3, f"t{at}") for d in (1, 2, None) for at in range(11)] + [(4, None, None, "x"), (4, 7, 2, "y")]
    df = spark.createDataFrame(rows, "d long, at long, part long, name string")
    plain = stream.stream_of(df, "d", ["at"], F.col("name"), 3)
    split = stream.stream_of(df, "d", ["at"], F.col("name"), 3, F.col("part"))
    assert split.dtypes == plain.dtypes
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect())) and split.count() == len(rows)


def png(image, depth, kind, filters, interlaced=False, palette=None):
    """PNG bytes of image[h, w, channels] by the definition of the format, one filter after the other on its lines."""
    h, w, channels = image.shape
    step = max(1, channels * depth // 8)

    def row(values):
        if depth == 16:
            return values.astype(">u2").tobytes()
        bits = "".join(f"{v:0{depth}b}" for v in values.reshape(-1).tolist())
        bits += "0" * (-len(bits) % 8)
        return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))

    def coded(part):
        out, above = b"", None
        for y in range(len(part)):
            raw = row(part[y])
            above = above or bytes(len(raw))
            mode = filters[y % len(filters)]
            line = bytearray()
            for x, v in enumerate(raw):
                a, b, c = (raw[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
                near = min((abs(a + b - c - a), 0, a), (abs(a + b - c - b), 1, b), (abs(a + b - c - c), 2, c))[2]
                line.append((v - (0, a, b, (a + b) // 2, near)[mode]) % 256)
            out, above = out + bytes([mode]) + bytes(line), raw
        return out

    if interlaced:
        parts = [image[t::d, left::a] for t, left, d, a in images.PASSES]
        data = b"".join(coded(p) for p in parts if p.shape[0] and p.shape[1])
    else:
        data = coded(image)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    plte = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, int(interlaced)))
    return b"\x89PNG\r\n\x1a\n" + head + plte + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
def test_png_of_all_kinds(interlaced):
    r = np.random.default_rng(6)
    for kind, depths in ((0, (1, 2, 4, 8, 16)), (2, (8, 16)), (3, (1, 2, 4, 8)), (4, (8, 16)), (6, (8, 16))):
        for depth, (h, w) in itertools.product(depths, ((1, 1), (9, 13), (16, 3))):
            channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
            image = r.integers(0, 1 << depth, (h, w, channels))
            palette = r.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8) if kind == 3 else None
            eight = image >> 8 if depth == 16 else image * 255 // ((1 << depth) - 1) if kind != 3 else image
            expected = palette[image[:, :, 0]] if kind == 3 else np.repeat(eight[:, :, :1], 3, 2) if channels < 3 else eight[:, :, :3]
            for filters in ((0,), (1, 2), (3, 4), (4, 3, 2, 1, 0)):
                got = images.decode(png(image, depth, kind, filters, interlaced, palette))
                assert got is not None and (got == expected).all(), (kind, depth, h, w, filters)


def test_tars_in_ranges_and_as_values(spark, tmp_path):
    rows = [(k % 2, k, f"{k}.{e}", bytearray([k] * (k * 700))) for k, e in enumerate(["jpg", "png", "json", "JPG", "txt", "jpeg", "png"])]
    members = spark.createDataFrame(rows, "shard long, member_idx int, name string, bytes binary")
    assert sorted(map(tuple, images.write_tars(members, f"file://{tmp_path}").collect())) == [(0, 4), (1, 3)]
    expected = {("00000", n, bytes(b)) for s, _, n, b in rows if s == 0 and n.lower().endswith(("jpg", "png", "jpeg"))} | {("00001", n, bytes(b)) for s, _, n, b in rows if s == 1 and n.lower().endswith(("jpg", "png", "jpeg"))}
    for size in (1, 1000, 8 << 20):
        got = images.tar_members(spark, f"{tmp_path}/*.tar", batch_bytes=size).collect()
        assert {(r["shard"], r["name"], bytes(r["bytes"])) for r in got} == expected and len(got) == len(expected)
    whole = spark.read.format("binaryFile").load(f"{tmp_path}/*.tar").select("path", "content")
    broken = whole.unionByName(spark.createDataFrame([("none", None), ("bad", bytearray(b"not a tar" * 100))], "path string, content binary"))
    assert {r["name"] for r in images.tar_bytes_members(broken, "path", "content").collect()} == {n for _, _, n, _ in rows if n.lower().endswith(("jpg", "png"))}


@pytest.mark.parametrize("size", [2, 6, 10, 1 << 20])
def test_flat_files_in_ranges(spark, tmp_path, size):
    r = np.random.default_rng(7)
    files = {"a": [[], [1], [2, 3], [], [4] * 30, [5]], "b": [], "c": [r.integers(0, 9, int(n)).tolist() for n in r.integers(0, 9, 40)]}
    for name, docs in files.items():
        tail = [7, 7] if name != "c" else []
        (tmp_path / f"{name}.bin").write_bytes(np.array([*itertools.chain(*[[*d, 65535] for d in docs]), *tail], "<u2").tobytes())
    got = token_files.read_flat(spark, f"{tmp_path}/*.bin", size=size).collect()
    assert sorted((x["shard"], x["doc"], x["tokens"]) for x in got) == [(name, k, d) for name, docs in sorted(files.items()) for k, d in enumerate(docs)]


def test_shards_of_unequal_documents_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, [1, 2]), (0, 2, [3])], "shard long, doc_id long, tokens array<int>")
    with pytest.raises(Exception, match="differ in length"):
        token_files.write_npy(rows, f"file://{tmp_path}/x")
    assert not list(tmp_path.glob("x/*.npy"))


def test_npy_files(spark, tmp_path):
    np.save(tmp_path / "two.npy", np.arange(12, dtype=np.uint16).reshape(4, 3))
    np.save(tmp_path / "one.npy", np.array([5, 6], np.int64))
    np.save(tmp_path / "none.npy", np.zeros((0, 3), np.int32))
    got = sorted((r["shard"], r["doc"], r["tokens"]) for r in token_files.read_npy(spark, f"{tmp_path}/*.npy", size=12).collect())
    assert got == [("one", 0, [5]), ("one", 1, [6]), *(("two", k, [3 * k, 3 * k + 1, 3 * k + 2]) for k in range(4))]


def test_counts_of_any_length(spark):
    r = np.random.default_rng(8)
    docs = {d: r.choice(list("ab"), 60).tolist() for d in range(6)} | {9: ["a"] * 50}
    tokens = spark.createDataFrame([(d % 2, d, p, t) for d, x in docs.items() for p, t in enumerate(x)], "shard long, doc_id long, pos int, tok string")
    index = ngram.build_index(tokens, 2)
    asked = [docs[int(d)][int(a) : int(a) + int(n)] for d, a, n in zip(r.integers(0, 6, 40), r.integers(0, 30, 40), r.integers(0, 30, 40), strict=True)] + [["a"] * 17, ["a"] * 51, ["z"] * 5, docs[0], [*docs[0], "a"]]
    prompts = spark.createDataFrame([(k, x) for k, x in enumerate(asked)], "prompt_id long, ids array<string>")
    want = {k: sum(sum(d[i : i + len(x)] == x for i in range(len(d) - len(x) + 1)) if x else len(d) for d in docs.values()) for k, x in enumerate(asked)}
    got = {x["prompt_id"]: (x["cnt"], x["approx"]) for x in ngram.count(index, prompts, stream=tokens, reach=2).collect()}
    assert got == {k: (n, False) for k, n in want.items()}
    with pytest.raises(Exception, match="longer than the index"):
        ngram.count(index, prompts, reach=2).collect()

    expected = {}
    for k, x in enumerate(asked):
        for n in range(len(x), -1, -1):
            after = [d[i + n] for d in docs.values() for i in range(len(d) - n) if d[i : i + n] == x[len(x) - n :]]
            if after:
                expected[k] = (n, sorted((t, after.count(t)) for t in set(after)))
                break
    found = {}
    for x in ngram.ntd(index, prompts, stream=tokens, reach=2).collect():
        found.setdefault(x["prompt_id"], (x["suffix_len"], []))[1].append((x["tok"], x["cont_cnt"]))
    assert {k: (n, sorted(v)) for k, (n, v) in found.items()} == expected


def test_speed():
    assert evaluation.speed(tokenizers.PRESETS["color-small"], im.noise(2)) > 0
    assert im.noise(2, 16).shape == (2, 16, 16, 3) and (im.noise(2) == im.noise(2)).all()


def test_running_total_over_ranges(spark):
    df = spark.createDataFrame([(f"k{i:03d}", i % 5) for i in range(300)], "name string, n long").repartition(7)
    got = {r["name"]: r["first"] for r in stream.running_total(df, ["name"], "n", "first").collect()}
    assert got == {f"k{i:03d}": sum(j % 5 for j in range(i)) for i in range(300)}
    sizes = spark.createDataFrame([(i % 3, i, i % 4) for i in range(200)], "shard long, doc_id long, n long")
    for width in (1, 3, 4096):
        rows = stream.offsets(sizes, width, ["shard"]).collect()
        assert {(r["shard"], r["doc_id"]): r["offset"] for r in rows} == {(i % 3, i): sum(j % 4 + 1 for j in range(i) if j % 3 == i % 3) for i in range(200)}


def test_progress_before_anything_is_done(spark):
    row = spark.range(1).select(evaluation.progress(F.lit(0), F.lit(0), F.lit(0)).alias("p")).first()["p"]
    assert row.asDict() == {"rate": None, "percent": None, "eta": None}


def test_command_line(spark, tmp_path, monkeypatch):
    call = lambda *args: cli.run(spark, cli.parser().parse_args([str(a) for a in args]))
    pictures = [(k, 32, 32, bytearray(np.roll(im.gradient(32), k * 5, 1).tobytes())) for k in range(4)]
    images.write_images(spark.createDataFrame(pictures, "img_id long, height int, width int, data binary"), f"file://{tmp_path}/pics")
    monkeypatch.setitem(tokenizers.PRESETS, "toy", tokenizers.Color(32, 8, 3))
    told = call("tokenize", "--images", f"{tmp_path}/pics", "--preset", "toy", "--out", f"{tmp_path}/tokens", "--flat", f"file://{tmp_path}/flat").first()
    assert (told["images"], told["failed"]) == (4, 0)
    assert token_files.read_config(spark, f"{tmp_path}/flat/config")["num_images"] == 4
    tokens = {r["img_id"]: r["tokens"] for r in spark.read.parquet(f"{tmp_path}/tokens").collect()}
    assert [r["tokens"] for r in token_files.read_flat(spark, f"{tmp_path}/flat/*.bin").orderBy("doc").collect()] == [tokens[k] for k in range(4)]
    call("detokenize", "--tokens", f"{tmp_path}/tokens", "--preset", "toy", "--out", f"file://{tmp_path}/back")
    assert len(list((tmp_path / "back").glob("*.png"))) == 4
    assert call("build-index", "--tokens", f"{tmp_path}/tokens", "--out", f"{tmp_path}/index", "--order", 2, "--shards", 2).count() == 2
    first = ",".join(map(str, tokens[0][:2]))
    want = sum(t[i : i + 2] == tokens[0][:2] for t in tokens.values() for i in range(15))
    assert call("query", "--index", f"{tmp_path}/index", "--mode", "count", "--prompt", first).first()["cnt"] == want
    assert call("query", "--index", f"{tmp_path}/index", "--mode", "ntd", "--prompt", first, "--max-support", 2).count() <= 2
    made = call("generate", "--index", f"{tmp_path}/index", "--seeds", f"{first};", "--num-tokens", 2, "--max-context", 2, "--out", f"{tmp_path}/made").collect()
    assert sorted(len(r["tokens"]) for r in made) == [2, 4]
    assert [r["copy"] for r in call("memorized", "--generated", f"{tmp_path}/tokens", "--tokens", f"{tmp_path}/tokens").collect()] == [True] * 4
    assert call("train-codebook", "--images", f"{tmp_path}/pics", "--preset", "tiny", "--out", f"{tmp_path}/book", "--iterations", 1).first()["dimensions"] == 3072
    shards = images.image_files(spark, f"{tmp_path}/pics").select(F.lit(3).alias("shard"), F.lit(0).alias("member_idx"), F.lit("x.png").alias("name"), F.col("content").alias("bytes")).limit(1)
    images.write_tars(shards, f"file://{tmp_path}/tars")
    out = call("tokenize-tars", "--shards-dir", f"{tmp_path}/tars", "--preset", "toy", "--out", f"file://{tmp_path}/shards", "--concat", f"file://{tmp_path}/all/tokenized.0")
    assert [r["docs"] for r in out.collect()] == [1] and (tmp_path / "all" / "tokenized.0").stat().st_size == 34
