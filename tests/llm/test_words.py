"""Collocations, spelling variants and the Jaccard join against plain loops, with odd tables and forced boundaries."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from test_llm import LONG, ODD
from tokenlake.llm import collocations, jaccard_join, near_dedup, spelling
from tokenlake.llm.store import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WIDE = "doc_id long, text string, lang string, word string, key long, n long, node long, band long"


def wide(spark, rows):
    """A table with columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, x, "w", 1, 2, 3, 4) for d, t, x in rows], WIDE)


def told(seed, docs, words):
    r = random.Random(seed)
    return [" ".join(r.choice(words) + r.choice(["", "", "", ".", "\n", "; "]) for _ in range(r.randint(0, 60))) for _ in range(docs)]


def brute_collocations(rows, least, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    for (lang, *w), a in f.items():
        if len(w) == 1 or a < least:
            continue
        if len(w) == 2 and any(b >= least and 2 * b >= a and x == lang and len(v) == 3 and w in (v[:2], v[1:]) for (x, *v), b in f.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("shard,cells,bits", [(1 << 19, 1 << 21, 27), (32, 50, 15)])
def test_collocations(spark, shard, cells, bits):
    """Also with shards and batches so small that pieces are cut, and a bitmap with room for few."""
    rows = [(i, t, [None, "und", "en", "fr"][i % 4]) for i, t in enumerate(told(1, 80, ["of", "the", "The", "é", "ÀB", "a", "#", "\tx"]))]
    rows += [(None, None, None), (None, "", "de"), (7, ODD[9][1] + "ab of the", "en"), (7, "a a a a a a a a a a a a a", "xx"), (8, ". ,\n", "yy"), (9, "ab " * 3000, "en")]
    plan = collocations.Plan(shard_words=shard, cells=cells, bits=bits)
    got = sorted(map(tuple, collocations.collocations(wide(spark, rows), plan).collect()))
    assert got == brute_collocations(rows, 10)


def test_collocations_top_and_ties(spark):
    rows = [(0, ". ".join(f"x{i} y{i}" for i in range(50)) + ". ", "en")] * 10
    got = collocations.collocations(wide(spark, rows), collocations.Plan(top=7)).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 10, 7)
    assert collocations.collocations(wide(spark, []), collocations.Plan()).count() == 0


def test_collocation_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(10**14, 10**14 + 1, 10**14 + 3), (7, 7, 7), (3, 10, 9)], "a long, l long, r long")
    got = df.select("a", "l", "r", collocations._score("a", "l", "r").alias("s")).collect()
    assert all(x["s"] == 10**6 * x["a"] ** 2 // (x["l"] * x["r"]) for x in got)


def test_position_bitmaps():
    """Shifts carry over blocks, and popcounts are the numbers of places."""
    r = np.random.default_rng(2)
    for size in (1, 7, 8, 9, 400):
        keys = r.integers(0, 6, size).astype(np.uint64)
        opens = r.random(size) < 0.2
        opens[0] = True
        for own in {size, max(1, size // 2)}:
            want = Counter()
            for i in range(own):
                for k in (2, 3):
                    if i + k <= size and keys[i : i + k].all() and not opens[i + 1 : i + k].any():
                        want[tuple(keys[i : i + k].tolist())] += 1
            got = Counter()
            for parts, n in collocations.Shard(keys, opens).phrases(own, 3, None, 64):
                for key, c in zip(zip(*(p.tolist() for p in parts), strict=True), n.tolist(), strict=True):
                    got[key] += c
            assert got == want


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows, spoil, least=7):
    n = Counter()
    for d, text, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if spoil and h % spoil == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least
    n = {w: c for w, c in n.items() if c >= 2}
    form, out = {}, []
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out.append((w, form[w], n[w], len(found), n[form[w]] if form[w] else None))

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, f, root(w), c, k, m) for w, f, c, k, m in out)


@pytest.mark.parametrize("plan", [spelling.Plan(spoil=3), spelling.Plan(spoil=31, shard_words=3, pass_bytes=500, batch=2), spelling.Plan(shard_chars=9)])
def test_spelling_variants(spark, plan):
    """Also with many shards and passes, and with words longer than a shard."""
    r = random.Random(4)
    base = ["".join(r.choice("abÀéÿ×") for _ in range(r.randint(6, 9))) for _ in range(12)]
    chain = ["spelling"] * 300 + ["speling"] * 30 + ["spelingg"] * 3 + ["spellings"] * 30 + ["spelings"] * 3
    text = [" ".join(r.choice(base) + r.choice(["", "", "", "a", "b"]) + r.choice([" ", "1", "-"]) for _ in range(60)) for _ in range(12)]
    rows = [(i, t, "x") for i, t in enumerate(text)] + [(i, " ".join(chain[i::4]), "x") for i in range(4)]
    rows += [(None, "Nameless nameless NAMELESS", None), (1, None, None), (1, "", "x"), (5, "b" * 3000 + " " + "b" * 3000 + " " + "b" * 2999 + " " + "b" * 2999, "x")]
    got = sorted(map(tuple, spelling.spelling_variants(wide(spark, rows), plan).collect()))
    assert got == brute_spelling(rows, plan.spoil)


def test_spelling_empty_and_segments(spark):
    assert spelling.spelling_variants(wide(spark, []), spelling.Plan()).count() == 0
    text = "abc éé " * 50 + "x" * 90 + " y"
    for size in (1, 7, 64, 10**6):
        parts = list(spelling._segments(text, size))
        assert "".join(parts) == text and all(not (a[-1].isalpha() and b[0].isalpha()) for a, b in zip(parts, parts[1:], strict=False))


def test_trie_meets_each_neighbour_once():
    r = random.Random(5)
    for size in (0, 1, 90, 90):
        words = sorted({"".join(r.choice("abéÿ×") for _ in range(r.randint(0, 5))) for _ in range(size)})
        size = len(words)
        some = r.sample(words, size // 2)
        owner, other = spelling.Trie.build(words).near(spelling.Trie.build(sorted(some)), cells=7)
        assert sorted(zip(owner.tolist(), other.tolist(), strict=True)) == sorted((i, j) for i, a in enumerate(sorted(some)) for j, b in enumerate(words) if a != b and near(a, b))
        owner, other = spelling.Trie.build(words).near(spelling.Trie.build(words))
        assert sorted(zip(owner.tolist(), other.tolist(), strict=True)) == sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if a != b and near(a, b))


def brute_join(rows, k=3, percent=90):
    sets = []
    for d, text, _ in rows:
        w = tuple(re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)))
        sets.append((d, {w[i : i + k] for i in range(len(w) - k + 1)} if len(w) >= k else {w} - {()}))
    head = {d: d for d, _ in sets if d is not None}

    def top(d):
        while head[d] != d:
            d = head[d]
        return d

    for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None], 2):
        if x & y and 100 * len(x & y) >= percent * len(x | y):
            p, q = top(a), top(b)
            head[max(p, q)] = min(p, q)
    return sorted(((d, len(x), None if d is None else top(d)) for d, x in sets), key=str)


def variants(seed):
    """Groups of texts of all sizes, each with copies in which few or many words differ, and chains of them."""
    r = random.Random(seed)
    out = []
    for size in (1, 2, 3, 5, 9, 11, 12, 13, 14, 20, 21, 22, 24, 30, 31, 32, 60, 61, 150, 400):
        words = [f"w{r.randrange(10**6)}" for _ in range(size)]
        for _ in range(6):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(r.choice([0, 1, 1, 1 + size // 60])):
                at = r.randrange(len(words) + 1)
                words[at : at + r.choice([0, 1])] = r.choice([[], [f"n{r.randrange(10**6)}"]])
                words = words or ["x"]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("plan", [{}, {"frequent": 1, "bits": 15}, {"subsets": 1}, {"scan": 1e6}, {"block": 2, "frequent": 10**6}])
def test_jaccard_join(spark, plan):
    """By all boundaries: none light, as many light as can be, and by cost; lists whole and in blocks."""
    rows = [(i, t, "x") for i, t in enumerate(variants(6))] + [(d, t, x) for d, t, x in ODD]
    rows += [(1000 + i, LONG + f" tail{i} more{i}", None) for i in range(30)]
    got = jaccard_join.jaccard_join(wide(spark, rows), jaccard_join.Plan(**plan)).collect()
    assert sorted(map(tuple, got), key=str) == brute_join(rows)


@pytest.mark.parametrize("join", ["jaccard", "near"])
def test_rows_of_one_id_are_one_node(spark, join):
    """Texts that only an id joins are one component, and so is what is linked with them."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, one, "x"), (4, one, "x"), (5, two, "x"), (3, two, "x"), (5, two, "x"), (2, three, "x"), (9, three, "x"), (9, "", "x")]
    run = jaccard_join.jaccard_join if join == "jaccard" else near_dedup.near_duplicates
    got = {(r["doc_id"], r["component_id"]) for r in run(wide(spark, rows)).collect() if r["n_shingles"]}
    assert got == {(5, 3), (4, 3), (3, 3), (2, 2), (9, 2)}


def test_jaccard_join_empty(spark):
    assert jaccard_join.jaccard_join(wide(spark, [])).count() == 0


def test_sizes_are_all_that_can_link():
    plan = jaccard_join.Plan()
    for n in range(1, 60):
        want = set()
        for m in range(1, 80):
            c = next((c for c in range(1, min(n, m) + 1) if 100 * c >= 90 * (n + m - c)), None)
            if c and c < max(n, m):
                want.add((min(n, m), max(n, m), c))
        assert set(plan.sizes(n)) == want
    assert jaccard_join.boundary([], plan) == plan.largest_light() + 1
    costs = [{"n": n, "nodes": 10, "places": 100} for n in range(1, plan.largest_light() + 1)]
    assert 1 < jaccard_join.boundary(costs, plan) <= plan.largest_light()


@pytest.mark.parametrize("n,m", [(10, 9), (12, 12), (19, 20), (21, 21)])
def test_a_shared_subset_is_a_link(n, m):
    plan, r = jaccard_join.Plan(), np.random.default_rng(n * m)
    a, b = min(n, m), max(n, m)
    for _ in range(60):
        x = r.permutation(30).astype(np.uint64)
        y = x[r.permutation(n + 1)[:m]] if m <= n + 1 else x[:m]
        x = x[:n]
        keys = [{k for p, q, k1, k2 in jaccard_join.subsets(plan, s) if (p, q) == (a, b) for k in zip(k1.tolist(), k2.tolist(), strict=True)} for s in (x, y)]
        both = len(np.intersect1d(x, y))
        if both == n == m:
            continue  # equal sets are one node
        assert bool(keys[0] & keys[1]) == (100 * both >= 90 * (n + m - both)), (n, m, both)


def test_bound_never_rejects_what_links(spark):
    """The parities of similar sets differ in no more places than the sets in elements."""
    texts = ["a " + " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(300)) + " b"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], ["doc_id", "text"])

    class Never:
        value = staticmethod(lambda keys: np.zeros(len(keys), bool))

    out = next(jaccard_join._nodes(jaccard_join.Plan(), 5, Never)(iter([batch])))
    p = np.array([[out.column(5 + k)[i].as_py() for k in range(jaccard_join.WIDE)] for i in (0, 1)], np.int64).view(np.uint64)
    sets = [near_dedup.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 3)[0] for t in texts]
    assert int(np.bitwise_count(p[0] ^ p[1]).sum()) <= len(np.setxor1d(*sets)) == 2


def test_roots_follow_long_chains(spark):
    links = Scratch(spark, "chain").write(spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, form string"), "links")
    assert {(r["word"], r["root"]) for r in spelling.roots(links, Scratch(spark, "roots")).collect()} == {(f"w{i}", "w40") for i in range(40)}
