"""Learned operators and the licence scan against plain loops, and odd tables through the pipeline and the URL filter."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tokenlake.llm import decontamination, langid, license_scan, packing, quality_cnn, suffix_dedup, url_filter


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


class DictKneserNey:
    """Interpolated Kneser-Ney by the book, in dictionaries of strings."""

    def __init__(self, texts, order):
        self.order = order
        grams = Counter()
        for text in texts:
            s = self.plain(text)
            grams.update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
        self.levels = [None] * (order + 1)
        for k in range(order, 0, -1):
            n1, n2 = (sum(c == n for c in grams.values()) for n in (1, 2))
            total, kinds = Counter(), Counter()
            for g, c in grams.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.levels[k] = (grams, total, kinds, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
            grams = Counter(g[1:] for g in grams)
        self.letters = len(self.levels[1][0])

    def plain(self, text):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
        return " " * (self.order - 1) + re.sub(" +", " ", low).lstrip(" ")

    def prob(self, context, char):
        p = 1 / (self.letters + 1)
        for k in range(1, self.order + 1):
            grams, total, kinds, discount = self.levels[k]
            c = context[len(context) - k + 1 :] if k > 1 else ""
            if total[c]:
                p = max(grams[c + char] - discount, 0) / total[c] + discount * kinds[c] / total[c] * p
        return p

    def bits(self, text):
        s = self.plain(text)
        return -sum(math.log2(self.prob(s[i - self.order + 1 : i], s[i])) for i in range(self.order - 1, len(s))) / (len(s) - self.order + 1)


def test_language_models_by_the_book(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select("lang", "text").orderBy("doc_id").collect()
    samples = defaultdict(list)
    for r in docs:
        if r["lang"] and len(samples[r["lang"]]) < 9 and 0 < len(r["text"]) < 3000 and any(c.isalpha() for c in r["text"]):
            samples[r["lang"]].append(r["text"])
    plan = langid.Plan(left_out=100)  # nothing is left out of samples this small
    model = langid.Identifier(dict(samples), plan)
    plain = [DictKneserNey(samples[k], plan.order) for k in model.languages]
    texts = [r["text"][:400] for r in docs[::7] if re.search(r"[^\W\d_]", r["text"][:400])][:25] + ["zzz ŵ 日本語 x", "a"]
    bits, _ = model.entropies(texts)
    expected = np.array([[m.bits(t) for m in plain] for t in texts])
    assert np.allclose(bits, expected, rtol=1e-4)
    names, score, least, _ = model.identify(texts)
    assert names == [model.languages[i] for i in expected.argmin(1)]
    assert np.allclose(least, expected.min(1), rtol=1e-4)
    shares = np.exp(-model.sharpness * (expected - expected.min(1, keepdims=True)))
    assert np.allclose(score, 1 / shares.sum(1), rtol=1e-2)


def test_language_sample_is_bounded_by_language(spark):
    rows_ = [("aaa bbb", "x", 1)] * 3000 + [(f"ccc ddd {'e' * (k % 50)} {k}", "y", k) for k in range(3000)] + [("zzz", "z", None)]
    labelled = spark.createDataFrame(rows_, "text string, lang string, key long")
    seen = {}
    real = langid.Identifier
    try:
        langid.Identifier = lambda samples, plan: seen.update(samples) or real(samples, plan)
        langid.fit(labelled, langid.Plan(per_language=40))
    finally:
        langid.Identifier = real
    assert len(seen["x"]) <= 1 and 20 <= len(seen["y"]) <= 40 and set(seen) == {"x", "y", "z"}


def loop_score(net, text):
    """The network's forward pass, a byte and a filter at a time."""
    p, w = net.plan, {k: v.astype(float) for k, v in net.w.items()}
    over = p.width - p.stride
    pooled = []
    for at in range(0, max(len(text), 1), p.chunk):
        chunk = text[at : at + p.chunk + over].ljust(p.chunk + over, b"\0")
        best = []
        for f in range(p.filters):
            sums = []
            for start in range(0, len(chunk) - p.width + 1, p.stride):
                sums.append(sum(w["embed"][chunk[start + i], j] * w["filter"][i * p.embedding + j, f] for i in range(p.width) for j in range(p.embedding)))
            best.append(max(0.0, max(sums) + w["bias"][f]))
        pooled.append(best)
    m = np.array(pooled)
    features = np.concatenate([m.mean(0), m.max(0), m.min(0)])
    return 1 / (1 + math.exp(-(features @ w["out"] + w["base"][0])))


def test_quality_network_by_loops(spark, sf):
    plan = quality_cnn.Plan(filters=4, chunk=64, embedding=2, width=8, sample=200, epochs=2)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    net = quality_cnn.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), plan)
    assert net.share is None
    texts = [b"", b"a", b"x" * 64, b"y" * 65, b"#$ %" * 90, *((r["text"] or "").encode()[:700] for r in docs.limit(6).collect())]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert np.allclose(net.score(data, offsets), [loop_score(net, t) for t in texts], atol=1e-4)


def loop_labels(scanner, words):
    """(labels without the base ones, score): matches and chains by their definition."""
    labels, score = set(), 0.0
    for t, (label, text) in enumerate(license_scan.TEMPLATES):
        own = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
        longest, ends = [], []
        for i in range(len(words)):
            k, end = 0, 0
            while k <= i:
                run = words[i - k : i + 1]
                at = next((j for j in range(len(own) - k) if own[j : j + k + 1] == run), None)
                if at is None:
                    break
                k, end = k + 1, at + k
            longest.append(k)
            ends.append(end)
        found = sorted((i - n + 1, ends[i] - n + 1, n) for i, n in enumerate(longest) if n >= 4 and (i + 1 == len(words) or longest[i + 1] <= n))
        best = []
        for i, (x, y, n) in enumerate(found):
            before = [c for (x2, y2, n2), c in zip(found[:i], best, strict=False) if x2 + n2 <= x <= x2 + n2 + 50 and y2 + n2 <= y]
            best.append(n + max(before, default=0))
        share = max(best, default=0) / len(own)
        score = max(score, share)
        if found and (share >= 0.8 or max(n for _, _, n in found) >= 12):
            labels.add(label)
    return labels, min(1.0, score)


def test_license_labels_and_score_by_their_definition(spark, sf):
    r = np.random.default_rng(3)
    wordings = [re.findall(r"\w+", t) for _, t in license_scan.TEMPLATES]
    made = []
    for _ in range(60):
        parts = []
        for _ in range(int(r.integers(1, 4))):
            w = list(wordings[int(r.integers(len(wordings)))])
            a, b = sorted(r.integers(0, len(w) + 1, 2).tolist())
            w = w[a:b] if r.random() < 0.6 else w
            for _ in range(int(r.integers(0, 3))):
                if w:
                    w[int(r.integers(len(w)))] = "other"
            parts += w + ["filler"] * int(r.integers(0, 60))
        made.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    docs = docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet").filter("lower(text) like '%licen%'").limit(40).selectExpr("doc_id + 1000 AS doc_id", "text"))
    scanner = license_scan.scanner(license_scan.Plan())
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    some = 0
    for x in rows(license_scan.scan_licenses(docs)):
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", texts[x["doc_id"]].lower())
        labels, score = loop_labels(scanner, words)
        assert set(filter(None, x["labels"].split(","))) == labels | set(filter(None, x["base_labels"].split(","))), texts[x["doc_id"]]
        assert abs(x["score"] - score) < 1e-9
        assert {s.split(":")[0] for s in filter(None, x["spans"].split(","))} == labels
        some += bool(labels)
    assert some > 20


def test_benchmark_in_many_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    one, many = ({(r["doc_id"], r["item_id"], r["edits"]) for r in rows(decontamination.contaminated(docs, items, p))} for p in (decontamination.Plan(), decontamination.Plan(block_bytes=1500)))
    assert one and one == many
    kept = decontamination.drop_contaminated(docs, items, decontamination.Plan(block_bytes=1500))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _, _ in one}


def test_hot_anchor_is_dealt_over_shards(spark):
    """One passage in very many contexts: strings that repeat across its shards are found, the others stay."""
    r = np.random.default_rng(4)
    common = "".join(r.choice(list("abcdefghij "), 180))
    base = ["".join(x) for x in r.choice(list("klmnopqrstuv "), (1500, 240))]
    # pairs 0 and 1, 2 and 3, ... of the first 300 share forty bytes of context; the others share none
    left = lambda i: base[i][:80] + (base[i // 2 * 2][80:120] if i < 300 else base[i][80:120])
    table = [(i, left(i) + common + base[i][120:]) for i in range(1500)]
    got = rows(suffix_dedup.suffix_dedup(spark.createDataFrame(table, "doc_id long, text string"), suffix_dedup.Plan(shard_bytes=20_000, partition_bytes=1 << 16)))
    seen = Counter(t[i : i + 200] for _, t in table for i in range(len(t) - 199))
    expected = {}
    for d, t in table:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        expected[d] = int(gone.sum())
    assert {r["rest"]["doc_id"]: r["n_removed"] for r in got} == expected and min(expected[i] for i in range(300)) >= 220


def test_packing_ties_and_many_equal_rows(spark):
    table = spark.createDataFrame([(1, "same text")] * 700 + [(k, "other words here") for k in range(300)], "doc_id long, text string")
    got = rows(packing.best_fit_packing(table))
    places = [(r["sequence_id"], r["offset"]) for r in got]
    assert len(got) == 1000 and len(set(places)) == 1000
    ends = defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in ends.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def test_url_filter_tables(spark):
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, rules).count() == 0 and url_filter.judge(none, rules.limit(0)).count() == 0
    host = ".".join(["a"] * 3000) + ".example.com"
    urls = [(1, f"http://{host}/en/{'x' * 100_000}?q"), (2, "http://" + "b" * 50_000 + ".net/fr/"), (3, "x://.example.com/en/"), (4, "x://com./")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in rows(url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), rules))}
    assert got == {1: ("example.com/en/", "block"), 2: ("net/fr/", "block"), 3: ("example.com/en/", "block"), 4: (None, "allow")}
    deep = spark.createDataFrame([("block", "a.b.c.d", "/"), ("allow", "d", "/x/")], "verdict string, host string, path string")
    seen = spark.createDataFrame([(1, "x://z.a.b.c.d/"), (2, "x://b.c.d/x/"), (3, "x://a.b.c.d/x/")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in rows(url_filter.judge(seen, deep))} == {1: "a.b.c.d/", 2: "d/x/", 3: "a.b.c.d/"}


WORDS = " ".join(f"w{i}" for i in range(120))
ODD = [
    (1, WORDS, "en", "s", 1), (2, "start " + WORDS + " end", None, None, None), (3, WORDS, "en", "s", 1), (3, WORDS, "en", "s", 1), (None, WORDS + " x", None, "s", 2),
    (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, " \n ", "en", "s", 3), (7, "short text", "en", "s", 10), (9, "ab " * 20000, "en", "s", 60000),
    (10, " ".join(f"k{i}" for i in range(40000)), "en", "s", 230000), (11, "one two three four five six seven eight nine ten eleven " + "question what is the capital of nowhere land at noon", "en", "s", 5),
]
TYPES = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "Question: what is the capital of Nowhere Land at noon"


def test_pipeline_with_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    # an extra column, by a name that operators use inside
    spark.createDataFrame([(*r, "x") for r in ODD], f"{TYPES}, rest string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = p.quality(spark, docs, str(tmp_path))
    assert good.columns == p.COLUMNS and sorted((r["doc_id"] or 0) for r in good.collect()) == [0, 1, 2, 3, 3, 10, 11]
    near = p.near(spark, good, str(tmp_path))
    assert sorted((r["doc_id"] or 0) for r in near.collect()) == [0, 1, 10, 11]
    cut = p.substrings(spark, near, str(tmp_path))
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == p.COLUMNS and texts[1] == WORDS and texts[None] == "x" and len(texts[10].split()) == 40000
    clean = p.decontaminate(spark, cut, str(tmp_path))
    assert sorted((r["doc_id"] or 0) for r in clean.collect()) == [0, 1, 10]
    packed = rows(p.run(spark, str(tmp_path)))
    assert {r["doc_id"] for r in packed} == {1, None, 10} and list(packed[0]) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("what", ["documents", "benchmark"])
def test_pipeline_with_an_empty_table(spark, tmp_path, what):
    import corpus_pipeline as p

    spark.createDataFrame([] if what == "documents" else ODD[:3], TYPES).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if what == "benchmark" else [(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["doc_id"] for r in rows(p.run(spark, str(tmp_path)))} == ({1} if what == "benchmark" else set())


def test_license_templates_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "All rights are reserved by the owner of this fine work. Licensed under CC BY 4.0."), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(license_scan.scan_licenses(docs, templates=[("own", "all rights are reserved by the owner of this fine work")]))}
    assert got[1]["labels"] == "cc-by,own" and got[1]["spans"] == "own:0-11" and got[1]["score"] == 1.0 and got[2]["labels"] == ""
