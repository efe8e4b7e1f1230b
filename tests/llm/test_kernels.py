"""Numpy kernels: hashes that no pattern cancels out, and segments of long texts that change nothing."""

import numpy as np
import pytest

from tokenlake.llm import arrays, blocks, quality_rules
from tokenlake.llm.arrays import BYTE_VALUES, Ranks, Spans, Words, grams


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def whole(text):
    data = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return data, np.array([0, len(data)])


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096, 1 << 16])
def test_complementary_patterns_hash_apart(n):
    a, b = thue_morse(n), thue_morse(n, "ba")
    w = Words(*whole(f"{a} {b}"))
    assert w.hash[0] != w.hash[1]
    assert quality_rules.measure(*whole(f"{a}\n{b}\n{a}"))["n_dup_lines"].tolist() == [1]
    x, y = (BYTE_VALUES[np.frombuffer(t.encode(), np.uint8)] for t in (a, b))
    assert grams(x, n)[0] != grams(y, n)[0]
    at = np.array([0]), np.array([n])
    assert Spans(x).hash(*at) != Spans(y).hash(*at)
    # words in the pattern, as windows of words
    p, q = (Words(*whole(" ".join(t))).hash for t in (a, b))
    assert grams(p, n)[0] != grams(q, n)[0] and Spans(p).hash(*at) != Spans(q).hash(*at)


def test_no_hash_stands_twice():
    r = np.random.default_rng(1)
    text = " ".join("".join(r.choice(list("ab"), int(n))) for n in r.integers(1, 40, 20000))
    assert len(set(Words(*whole(text)).hash.tolist())) == len(set(text.split()))
    x = BYTE_VALUES[np.frombuffer(text.encode(), np.uint8)]
    for n in (1, 2, 7, 32, 50):
        assert len(set(grams(x, n).tolist())) == len({text[i : i + n] for i in range(len(text) - n + 1)})


def test_segments_change_nothing(monkeypatch):
    r = np.random.default_rng(2)
    words = [f"w{x}" for x in r.integers(0, 300, 4000)]
    words[50] = "long" * 400
    text = "".join(w + str(s) for w, s in zip(words, r.choice([" ", "  ", "\n", " \t"], len(words)), strict=True))
    docs = [text, "", "one", "  ", text[:777] + "é" * 90, "x"]
    data = np.frombuffer("".join(docs).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(d.encode()) for d in docs)])
    one = whole(text)

    def everything():
        w = Words(data, offsets)
        found = blocks.find(one[0], one[1], 200, 32, True, BYTE_VALUES)
        return [w.hash, w.start, w.end, w.doc, w.first, grams(w.hash, 13), *found.values(), *quality_rules.measure(data, offsets).values(), *quality_rules.measure(*one).values()]

    expected = everything()
    assert len(expected[0]) == sum(len(d.split()) for d in docs)
    for size in (1000, 4096):
        for module in (arrays, blocks, quality_rules):
            monkeypatch.setattr(module, "SEGMENT", size)
        assert all(np.array_equal(a, b) for a, b in zip(everything(), expected, strict=True))


def test_ranks():
    mask = np.random.default_rng(3).integers(0, 2, 1003).astype(bool)
    at = np.arange(1004)
    assert (Ranks(mask)(at) == np.concatenate([[0], np.cumsum(mask)])).all()


def test_long_texts_in_parts_give_the_same(monkeypatch):
    from tokenlake.llm import decontamination, langid, packing, quality_cnn

    r = np.random.default_rng(4)
    kinds = ["word", "Été", "x1", "日本", "--", "'s", "12", "<|endoftext|>", "ΑΣ", "\n", "a" * 300]
    text = "".join(f"{kinds[int(k)]}{' ' * int(n)}" for k, n in zip(r.integers(0, len(kinds), 6000), r.choice([0, 1, 1, 1, 2], 6000), strict=True))
    encode = packing.encoder("")
    for step in (1, 50, 5000):
        parts = list(packing.cuts(text, step))
        assert "".join(parts) == text and sum((encode(x) for x in parts), []) == encode(text)
    assert len(list(packing.cuts(text, 50))) > 50

    whole_ = decontamination.normalise(text)
    items = decontamination.Items([1, 2, 3], [whole_[9000:9100], whole_[20000:20400].replace(b"word", b"werd", 2), b"x1"])
    found = items.find([whole_, b"x1", whole_[:50]])
    monkeypatch.setattr(decontamination, "PIECE", 700)
    assert decontamination.normalise(text) == whole_
    again = items.find([whole_, b"x1", whole_[:50]])
    assert found and [(d, i, e) for d, i, _, e in found] == [(d, i, e) for d, i, _, e in again]
    assert [x for x in found if x[3] == 0] == [x for x in again if x[3] == 0]

    model = langid.Identifier({"a": ["abc abd abe " * 20, "bca cab"], "b": ["xyz xzy yyx " * 20, "zzy word été"]})
    bits, letters = model.entropies([text])
    short = model.entropies([text[:3000]])
    for piece, of, expected in ((1000, text, (bits, letters)), (1, text[:3000], short), (7, text[:3000], short)):
        monkeypatch.setattr(langid, "PIECE", piece)
        b, n = model.entropies([of])
        assert np.allclose(b, expected[0]) and (n == expected[1]).all()

    net = quality_cnn.ByteCNN(quality_cnn.Plan(filters=3))
    net.share = None
    data, offsets = whole(text)
    rows, n = net.chunks(data, offsets)
    m = np.maximum(net.pool(rows)[0], 0)
    f = net.joined(m, n, np.array([0]))
    assert np.allclose(net.score(data, offsets), 1 / (1 + np.exp(-(f @ net.w["out"] + net.w["base"][0]))))
