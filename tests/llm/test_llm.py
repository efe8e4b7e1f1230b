"""Every operator of the subpackage against brute force, an exact round trip or held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import oracle
from tokenlake.llm import decontamination, langid, license_scan, near_dedup, packing, quality_cnn, quality_rules, queries, substring_dedup, suffix_dedup, url_filter
from tokenlake.llm.suffix_arrays import common_prefixes, eights, locate, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(130))
ODD = [
    (1, LONG, "x"),
    (2, "start " + LONG + " end", "x"),
    (3, LONG, None),
    (3, LONG, None),
    (None, LONG, "x"),
    (4, None, "x"),
    (5, "", "x"),
    (6, " \n\t ", "x"),
    (7, "short text", "x"),
    (8, "Short TEXT", "x"),
    (9, "ab " * 30000, "x"),
    (10, "é" * 500 + " 日本 " + "é" * 500, "x"),
    (11, "\n".join(["the same line of words here"] * 4), "x"),
    (12, LONG + " " + LONG.replace("w7 ", "changed "), "x"),
]
COLUMNS = "doc_id long, text string, rest string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and a column whose name the operators use inside."""
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def brute_substring(table, window=50):
    least = {}
    for d, text in table:
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, 2**63), 2**63 - 1 if d is None else d)
    out = []
    for d, text in table:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (2**63 - 1 if d is None else d):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_substring_dedup(which, request):
    table = request.getfixturevalue(which)
    got = rows(substring_dedup.substring_dedup(table))
    key = lambda x: (x[0] is None, x)
    assert sorted([(r["rest"]["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=key) == sorted(brute_substring(pairs(table)), key=key)


def test_substring_dedup_takes_any_number_of_batches(docs):
    plan = substring_dedup.Plan(window=12, gram=4, batches=6)
    got = rows(substring_dedup.substring_dedup(docs, plan))
    assert sorted((r["rest"]["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(brute_substring(pairs(docs), 12))


def kept(df):
    return sorted((r["rest"]["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(df))


def test_fingerprint_index_takes_further_tables(docs, spark, tmp_path):
    """A table after the other, with compaction, in an index that is opened anew each time, gives what one table gives."""
    plan = substring_dedup.Plan(window=12, gram=4, fanout=2)
    parts = list(substring_dedup._parts(docs, 5))
    got, levels = [], []
    for part in parts:
        index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", plan)
        got += kept(index.deduplicate(part))
        levels.append(sorted(x for x, _ in index.runs))
        index.close()
    assert levels == [[0], [1], [0, 1], [2], [0, 2]]
    assert sorted(got) == sorted(brute_substring(pairs(docs), 12))
    # the same table again: every window stands in the index, so only what no window covers stays
    again = kept(substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index").deduplicate(docs))
    assert [(d, n, n if n >= 12 else 0) for d, n, _, _ in again] == [(d, n, gone) for d, n, gone, _ in again]


def test_many_equal_rows(spark):
    """Rows of one id and text, and copies of a text, cost as much each as one of them."""
    text = " ".join(f"w{i % 700}" for i in range(1200))
    table = spark.createDataFrame([(7, text)] * 300 + [(100 + i, text) for i in range(100)], "doc_id long, text string")
    key = lambda x: x
    got = rows(substring_dedup.substring_dedup(table))
    assert sorted([(r["rest"]["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=key) == sorted(brute_substring(pairs(table)), key=key)
    got = rows(suffix_dedup.suffix_dedup(table))
    assert len(got) == 400 and {(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got} == {(len(text), len(text), 1)}


def brute_bytes(table, window=200):
    count = Counter()
    for _, text in table:
        raw = (text or "").encode()
        count.update(hash(raw[i : i + window]) for i in range(len(raw) - window + 1))
    out = []
    for d, text in table:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            if count[hash(raw[i : i + window])] > 1:
                gone[i : i + window] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("shard", [2 << 20, 2000])
def test_suffix_dedup(which, shard, request):
    table = request.getfixturevalue(which)
    got = rows(suffix_dedup.suffix_dedup(table, suffix_dedup.Plan(shard_bytes=shard, partition_bytes=1 << 16)))
    key = lambda x: (x[0] is None, x)
    assert sorted([(r["rest"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got], key=key) == sorted(brute_bytes(pairs(table)), key=key)


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for n, k in [(1, 2), (2, 1), (9, 1), (300, 2), (900, 3), (500, 256)]:
        text = r.integers(0, k, n).astype(np.uint8)
        raw, sa = text.tobytes(), suffix_array(text)
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        for j, got in enumerate(common_prefixes(text, sa).tolist()[1:], 1):
            x, y = raw[sa[j - 1] :], raw[sa[j] :]
            assert got == next((m for m in range(min(len(x), len(y))) if x[m] != y[m]), min(len(x), len(y)))


def test_locate():
    text = np.random.default_rng(2).integers(97, 100, 3000).astype(np.uint8)
    sa, raw, at = suffix_array(text), text.tobytes(), np.array([5, 100, 2000])
    lo, hi = locate(eights(text, 24)[at[:, None] + 8 * np.arange(3)], 20, text, sa, eights(text, 24))
    for p, a, b in zip(at, lo, hi, strict=True):
        assert sorted(sa[a:b]) == [i for i in range(3000) if raw[i : i + 20] == raw[p : p + 20]]


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    seen = [False] * len(w)
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            seen[i : i + 5] = [True] * 5
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n_repeat = sum(seen)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, n_repeat, len(w) < 10 or 100 * n_repeat > 20 * len(w)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_repetition_quality(which, request):
    table = request.getfixturevalue(which)
    got = rows(quality_rules.repetition_quality(table))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    key = lambda x: (x[0] is None, x)
    assert sorted([(r["doc_id"], *(r[k] for k in names)) for r in got], key=key) == sorted([(d, *brute_quality(t)) for d, t in pairs(table)], key=key)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.keep_good(table).count() == sum(r["kept"] for r in got)


def test_repetition_quality_keeps_clean_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 and toxic = 0")
    got = quality_rules.repetition_quality(spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id").filter("n_chars > 300"))
    assert got.filter("not kept").count() <= 0.1 * got.count()


def brute_near(table):
    sets = []
    for _, text in table:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    head = {d: d for d, _ in table}

    def top(d):
        while head[d] != d:
            d = head[d]
        return d

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and table[i][0] is not None and table[j][0] is not None and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = top(table[i][0]), top(table[j][0])
                head[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else top(d)) for (d, _), s in zip(table, sets, strict=True)]


@pytest.mark.parametrize("which", ["docs", "odd", "near"])
def test_near_duplicates(which, request, spark):
    if which == "near":  # a chain of edits, a star of edits and many exact copies
        r = np.random.default_rng(3)
        base = [f"t{i}" for i in range(120)]
        made, chain = [], list(base)
        for k in range(40):
            chain = list(chain)
            chain[int(r.integers(120))] = f"c{k}"
            made.append(chain)
            star = list(base)
            for _ in range(3):
                star[int(r.integers(120))] = f"s{k}"
            made.append(star)
            made.append(list(base))
        table = spark.createDataFrame([(int(i), " ".join(x)) for i, x in zip(r.permutation(1000), made, strict=False)], "doc_id long, text string")
    else:
        table = request.getfixturevalue(which)
    got = rows(near_dedup.near_duplicates(table))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=key) == sorted(brute_near(pairs(table)), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_sketch_estimates_similarity():
    a = np.random.default_rng(4).integers(0, 2**63, 2000).astype(np.uint64)
    for share in (0.0, 0.5, 0.8, 1.0):
        k = round(2000 * share)
        b = np.concatenate([a[:k], np.random.default_rng(5).integers(0, 2**63, 2000 - k).astype(np.uint64)])
        similarity = k / (4000 - k)
        assert abs((near_dedup.sketch(a, 512) == near_dedup.sketch(b, 512)).mean() - similarity) < 0.08
    assert (near_dedup.sketch(a[:1], 64) != np.iinfo(np.uint64).max).all()


def test_decontamination(spark, sf, docs):
    table = pairs(docs)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r for r in rows(decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")))}
    norm = {d: decontamination.normalise(t) for d, t in table}
    exact = {(d, i) for d, t in norm.items() for i, x in items if decontamination.normalise(x) in t}
    assert exact and exact <= set(got)
    for (d, i), r in got.items():
        assert r["edits"] <= r["n_bytes"] * 5 // 100
        if (d, i) in exact:
            assert r["edits"] == 0 and norm[d][r["start"] :].startswith(decontamination.normalise(dict(items)[i]))


def semi_global(item, text):
    line = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(line[j - 1] + (c != t), line[j] + 1, new[j - 1] + 1))
        line = new
    return min(line)


def test_decontamination_finds_every_place_within_the_budget():
    r = np.random.default_rng(6)
    letters = list("abcdefghij ")
    items = ["".join(r.choice(letters, int(n))).strip() for n in r.integers(60, 160, 12)]
    found = decontamination.Items(list(range(12)), [x.encode() for x in items])
    texts = []
    for _ in range(60):
        x = list(items[int(r.integers(12))])
        for _ in range(int(r.integers(0, 9))):
            at = int(r.integers(len(x)))
            x[at : at + int(r.integers(0, 2))] = ["z"] * int(r.integers(0, 2))
        texts.append(("".join(r.choice(letters, int(r.integers(0, 80)))) + "".join(x) + "".join(r.choice(letters, int(r.integers(0, 80))))).encode())
    got = {(d, i): e for d, i, _, e in found.find(texts)}
    for d, t in enumerate(texts):
        for k, x in enumerate(found.texts):
            edits = semi_global(x, t)
            assert ((d, k) in got) == (edits <= found.edits[k]), (d, k, edits)


def test_decontamination_odd(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (None, LONG[:200]), (4, "tiny"), (4, LONG[:200])], "item_id long, text string")
    got = rows(decontamination.contaminated(odd, items))
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter((d, i) for d in (1, 2, 3, 3, None, 12) for i in (None, 4))
    assert decontamination.drop_contaminated(odd, items).count() == len(ODD) - 6


def test_decontamination_short_items(spark):
    texts = ["So: what is 2 + 2? Four.", "What is 2 + 22", "问：你叫什么名字？答", "前问你叫什么名字答后", "a yes-man", "eyes yesterday", "x" * 30 + " WHAT IS 2 2", "", None, "café", "caf"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    short = [(1, "What is 2 + 2?"), (2, "你叫什么名字"), (3, "Yes!"), (4, "yes"), (5, "?!"), (6, None), (7, "caf")]
    items = spark.createDataFrame(short, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["edits"], r["n_bytes"]) for r in rows(decontamination.contaminated(docs, items))}
    assert got == {(0, 1): (3, 0, 11), (6, 1): (31, 0, 11), (2, 2): (4, 0, 18), (3, 2): (6, 0, 18), (4, 3): (2, 0, 3), (4, 4): (2, 0, 3), (10, 7): (0, 0, 3)}
    assert {r["doc_id"] for r in decontamination.drop_contaminated(docs, items).collect()} == {1, 5, 7, 8, 9}
    r = np.random.default_rng(10)
    some = ["".join(r.choice(list("ab "), int(n))).strip().replace("  ", " ") for n in r.integers(1, 19, 60)]
    found = decontamination.Items(list(range(60)), [x.encode() for x in some])
    texts = [re.sub(" +", " ", "".join(r.choice(list("ab "), int(n)))).strip() for n in r.integers(0, 200, 60)]
    expected = {(d, x, f" {t} ".index(f" {x} ")) for d, t in enumerate(texts) for x in some if x and f" {x} " in f" {t} "}
    assert {(d, found.texts[i].decode(), start) for d, i, start, edits in found.find([t.encode() for t in texts])} == expected


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(which, request):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    table = request.getfixturevalue(which)
    got = rows(packing.best_fit_packing(table))
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    expected = Counter()
    for d, text in pairs(table):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (at, n) in enumerate(packing.cut(len(ids), 1024)):
            expected[d, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
    assert Counter((r["rest"]["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(sequences) <= max(-(-total // 1024) + 1, 1.02 * total / 1024)


def test_packing_special_tokens(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["one <|endoftext|> two", "<|endoftext|><|endoftext|>", "a<|endoftext|>b\n <|endoftext|>", "<|endoftext| >", "<|startoftext|>", "<|ENDOFTEXT|>"]
    for plan in (packing.Plan(), packing.Plan(vocabulary=path("byte_bpe_50k.json"))):
        for x in texts:
            assert packing.encoder(plan.vocabulary)(x) == t.encode(x, add_special_tokens=False).ids
        got = rows(packing.best_fit_packing(spark.createDataFrame([(1, texts[1])], "doc_id long, text string"), plan))
        assert [(r["length"], r["ids_crc32"]) for r in got] == [(3, zlib.crc32(np.array([50256, 50256, 2], "<u4").tobytes()))]


def test_packing_uses_the_histogram_up():
    r = np.random.default_rng(7)
    for n in (0, 1, 50, 5000):
        histogram = np.bincount(np.minimum(r.lognormal(3.2, 1, n).astype(int) + 1, 64), minlength=65)
        used = np.zeros(65, int)
        for lengths, count in packing.pack(histogram):
            assert sum(lengths) <= 64
            np.add.at(used, list(lengths), count)
        assert (used == histogram).all()


def test_language_models(spark, sf):
    table = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    held_out = queries._bucket(4, 2)
    model = langid.fit(table.filter(~held_out).select("text", "lang", table.doc_id.alias("key")))
    assert model.languages == ["de", "en", "es", "fr"]
    m = model.models[0]  # the probabilities of all characters after a context sum to one, up to the unknown's share
    for context in m.grams[:: max(1, len(m.grams) // 20), 1:]:
        symbols = np.unique(m.grams[:, 0])
        total = (2.0 ** m.log2(np.column_stack([symbols, np.tile(context, (len(symbols), 1))]))).sum()
        assert 0.97 < total < 1.0 + 1e-9
    got = {r["doc_id"]: r for r in rows(langid.identify_languages(table, model, held_out))}
    truth = [(r["lang"], got[r["doc_id"]]) for r in table.collect() if got[r["doc_id"]]["held_out"] and r["n_chars"] > 40]
    assert sum(a == b["lang_pred"] for a, b in truth) >= 0.97 * len(truth)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_joint_table_equals_the_models():
    model = langid.Identifier({"a": ["abc abd abe " * 20, "bca cab"], "b": ["xyz xzy yyx " * 20, "zzy abc"]})
    text = "abc xyq zab é"
    seq = langid.Sequence([text], model.table, 4)
    c = langid.chars(seq, seq.at, 4)
    slow = [-m.log2(c).mean() for m in model.models]
    assert np.allclose(model.entropies([text])[0][0], slow, atol=1e-4)


def test_language_odd(spark, odd):
    labelled = spark.createDataFrame([("das ist der text und die sprache", "de", 1), ("this is the text and the language", "en", 2), (None, "en", 3), ("x", None, 4)], "text string, lang string, key long")
    got = rows(langid.identify_languages(odd, langid.fit(labelled), queries._bucket(4, 2)))
    assert len(got) == len(ODD)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {4, 5, 6}
    none = langid.fit(labelled.limit(0))
    assert {r["lang_pred"] for r in rows(langid.identify_languages(odd, none, queries._bucket(4, 2)))} == {"und"}


def test_quality_network(spark, sf, odd):
    table = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    held_out = queries._bucket(3, 1)
    model = quality_cnn.fit(table.filter(~held_out), labels.filter(~held_out))
    got = rows(quality_cnn.score_quality(table, model, held_out).join(labels, "doc_id").filter("held_out"))
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good])
    assert auc > 0.9
    odd_rows = rows(quality_cnn.score_quality(odd, model, held_out))
    assert len(odd_rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd_rows)
    none = quality_cnn.fit(table, labels.limit(0))
    assert {r["score"] for r in rows(quality_cnn.score_quality(odd, none, held_out))} == {0.5}


def test_network_gradients():
    net = quality_cnn.ByteCNN(quality_cnn.Plan(filters=3, chunk=32, embedding=2, width=8))
    net.share = None
    samples, labels = [b"hello world, this is text " * 3, b"#### $$$$ %%%% ####", b"ab"], np.array([1.0, 0.0, 1.0], np.float32)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data, offsets = np.frombuffer(b"".join(samples), np.uint8), np.cumsum([0, *map(len, samples)])

    def loss():
        p = net.score(data, offsets)
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    grads = net._gradients(samples, labels)
    for name, at in [("out", 2), ("base", 0), ("filter", (3, 1)), ("bias", 1), ("embed", (ord("#"), 0))]:
        net.w[name][at] += 1e-5
        up = loss()
        net.w[name][at] -= 2e-5
        down = loss()
        net.w[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-3, name


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_license_base(which, request):
    table = request.getfixturevalue(which)
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows(license_scan.scan_licenses(table)))
    expected = Counter()
    for d, text in pairs(table):
        w = LICENSE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places, labels = [], set()
        for phrase, label in license_scan.BASE_PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        expected[d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    assert got == expected


def test_license_automaton():
    r = np.random.default_rng(8)
    sequences = [r.integers(0, 4, int(n)).tolist() for n in r.integers(1, 30, 6)]
    automaton = license_scan.Automaton(sequences)
    stream = r.integers(0, 4, 200).tolist()
    for i, (n, state) in enumerate(automaton.statistics(stream)):
        has = lambda k: {t: min(j + k - 1 for j in range(len(s) - k + 1) if s[j : j + k] == stream[i - k + 1 : i + 1]) for t, s in enumerate(sequences) if any(s[j : j + k] == stream[i - k + 1 : i + 1] for j in range(len(s) - k + 1))}  # noqa: B023, E731
        assert n == max(k for k in range(i + 2) if k == 0 or has(k))
        if n:
            assert automaton.ends[state] == has(n)


def test_license_chain_looks_at_every_match_in_reach():
    rng = np.random.default_rng(5)
    s = license_scan.scanner(license_scan.Plan())
    for most in (10, 400):
        found = sorted({(int(x), int(y), int(n)) for x, y, n in zip(rng.integers(0, 900, 600), rng.integers(0, 900, 600), rng.integers(4, most, 600))})
        best = []
        for x, y, n in found:
            before = [c for (x2, y2, n2), c in zip(found, best) if x2 + n2 <= x <= x2 + n2 + 50 and y2 + n2 <= y]
            best.append(n + max(before, default=0))
        assert s.chain(found)[0] == max(best)
    behind = [(0, 0, 400), *((i, 5000 - 5 * i, 4) for i in range(1, 300)), (410, 410, 5)]
    assert s.chain(behind)[0] == 405


def test_license_labels():
    s = license_scan.scanner(license_scan.Plan())
    w = license_scan.words_of("Intro text. Licensed under the Apache License, Version 2.0. More. Released under the MIT License.")
    assert s.scan(w.hash, s.numbers(w.hash))[4] == "apache,apache-2.0,mit"
    w = license_scan.words_of("the terms of the use of this and any other text and so on")
    assert s.scan(w.hash, s.numbers(w.hash))[3:5] == ("", "")


def test_license_matches_are_judged_by_template():
    s = license_scan.scanner(license_scan.Plan())
    w = license_scan.words_of("Licensed under the Apache License, Version 2.0. The parser is fast.")
    got = s.scan(w.hash, s.numbers(w.hash))
    assert got[4] == "apache,apache-2.0" and got[5] == 1.0
    r = np.random.default_rng(9)
    s = license_scan.Scanner(license_scan.TEMPLATES)
    s.automaton = license_scan.Automaton(sequences := [r.integers(0, 3, int(n)).tolist() for n in r.integers(5, 40, 6)])
    stream = r.integers(0, 3, 300)
    expected = {}
    for t, own in enumerate(sequences):
        ends = lambda k, i: [j + k - 1 for j in range(len(own) - k + 1) if own[j : j + k] == stream[i - k + 1 : i + 1].tolist()]  # noqa: B023, E731
        longest = [max(k for k in range(i + 2) if k == 0 or ends(k, i)) for i in range(len(stream))]
        for i, n in enumerate(longest):
            if n >= 4 and (i + 1 == len(stream) or longest[i + 1] <= n):
                expected.setdefault(t, []).append((i - n + 1, min(ends(n, i)) - n + 1, n))
    assert s.matches(stream) == expected


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, sf):
    assert oracle.compare(oracle.connect(sf), queries.queries()[name](spark, sf), queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"op8_url_filter"}))
def test_sql_odd(name, spark, tmp_path):
    """Empty, short, very long and repetitive texts, and texts without words, in a table of distinct ids."""
    table = [(i, text, rest) for i, (_, text, rest) in enumerate(ODD)] + [(90, "a b\n\na b\n \n#<x> a b", None), (91, LONG[:-1], "x"), (92, " ".join(["one two"] * 60), "y")]
    spark.createDataFrame(table, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.compare(con, queries.queries()[name](spark, str(tmp_path)), queries.oracle_sql()[name]) == ""


def test_url_filter_odd(spark):
    urls = [
        (1, "http://Example.COM/en/x", "example.com", "/en/x", "example.com/en/", "block"),
        (1, "http://Example.COM/en/x", "example.com", "/en/x", "example.com/en/", "block"),
        (2, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "https://a.www.example.com/en/a/b?q#f", "a.www.example.com", "/en/a/b", "www.example.com/en/", "allow"),
        (4, None, "", "", None, "allow"),
        (5, "no scheme.com/en/", "", "", None, "allow"),
        (6, "x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        (7, "x://a.net?x=/fr/", "a.net", "", None, "allow"),
        (8, "x://a.net/fr/#", "a.net", "/fr/", "net/fr/", "block"),
        (None, "x://a.net/fr", "a.net", "/fr", None, "allow"),
        (9, "x://net/es/", "net", "/es/", "net/es/", "block"),
        (10, "x://com", "com", "", None, "allow"),
        (11, "", "", "", None, "allow"),
        (12, "a://b.com/c://d.net/fr/", "b.com", "/c://d.net/fr/", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(p, u, "x") for p, u, *_ in urls], "page_id long, url string, rule string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = sorted(map(tuple, url_filter.judge(pages, rules).collect()), key=str)
    assert got == sorted([(p, *x) for p, _, *x in urls], key=str)
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], COLUMNS)
    no = queries._bucket(4, 2)
    for df in (
        substring_dedup.substring_dedup(empty),
        suffix_dedup.suffix_dedup(empty),
        quality_rules.repetition_quality(empty),
        near_dedup.near_duplicates(empty),
        license_scan.scan_licenses(empty),
        packing.best_fit_packing(empty),
        langid.identify_languages(empty, langid.Identifier({}), no),
        quality_cnn.score_quality(empty, quality_cnn.ByteCNN(), no),
        decontamination.contaminated(empty, spark.createDataFrame([], "item_id long, text string")),
    ):
        assert df.count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in rows(p.quality(spark, docs, sf))}
    assert all(brute_quality(table[d]["text"])[5] is False for d in kept)
    now = docs.filter(docs.doc_id.isin(list(kept)))
    near = {d for d, _, c in brute_near(pairs(now)) if d == c}
    after = p.near(spark, now, sf)
    assert {r["doc_id"] for r in after.collect()} == near
    cut = p.substrings(spark, after, sf)
    assert cut.columns == p.COLUMNS
    expected = {d: h for d, _, _, h in brute_substring(pairs(after))}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in cut.collect()} == expected
    items = [decontamination.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in p.decontaminate(spark, cut, sf).collect()}
    assert clean == {r["doc_id"] for r in cut.collect() if not any(x in decontamination.normalise(r["text"]) for x in items)}
    packed = rows(p.run(spark, sf))
    assert {r["doc_id"] for r in packed} == clean


def test_near_duplicates_in_large_buckets(spark):
    """Buckets above the small size, in blocks, give the same components."""
    r = np.random.default_rng(9)
    base, made = [f"t{i}" for i in range(146)], []
    for k in range(160):
        x = list(base)
        for e in range(int(r.integers(0, 12))):
            x[int(r.integers(146))] = f"s{k if e % 2 else k // 8}"
        made.append(x)
    table = spark.createDataFrame([(int(i), " ".join(x)) for i, x in zip(r.permutation(1000), made, strict=False)], "doc_id long, text string")
    got = rows(near_dedup.near_duplicates(table, near_dedup.Plan(small=2, block=20)))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_near(pairs(table)))
    assert 1 < len({r["component_id"] for r in got}) < 150


def test_license_base_phrases_of_the_contract(spark):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    made = ["the General Public License alone", "GNU Lesser General Public License", "gnu  GNU General-Public\nLICENSE, cc_by", "Apache License; MIT\x00license CC BY-4.0", "gnu general public licence", "xgnu general public license"]
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    want = {}
    for d, text in enumerate(made):
        w = LICENSE_WORD.findall(text.lower())
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        want[d] = (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows(license_scan.scan_licenses(table))}
    assert got == want and [want[d][1] for d in range(6)] == [0, 0, 2, 3, 0, 0]
