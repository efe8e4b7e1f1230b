"""Generation within tasks gives what a join for each step gives."""

import numpy as np
import pyarrow as pa
import pytest
from tokenlake.operators import local_index, ngram, sampling

IDS = "prompt_id long, ids array<int>"


@pytest.fixture(scope="module")
def index(spark):
    r = np.random.default_rng(3)
    docs = [(i % 3, i, p, int(t)) for i in range(30) for p, t in enumerate(r.choice([0, 1, 2, 3, 70000, -5], 20, p=[0.4, 0.2, 0.15, 0.1, 0.1, 0.05]))]
    return ngram.build_index(spark.createDataFrame(docs, "shard int, doc_id long, pos int, tok int"), 5)


@pytest.fixture(scope="module")
def seeds(spark):
    """Also an empty seed, one with a token that nowhere stands, one longer than any context, and null ids."""
    return spark.createDataFrame([(1, [0]), (2, []), (3, [9, 9]), (4, [0, 1, 2, 3, 70000, 0, 1, 0]), (5, [1]), (6, None), (7, [1, 9])], IDS)


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("context,setting", [(9, {"t": 1.0, "k": 50}), (5, {"t": 0.7, "k": 3}), (1, {"k": 1})])
def test_tasks_and_steps_generate_the_same(index, seeds, context, setting):
    some = seeds.filter("ids is not null")
    near, far = (told(sampling.generate(index, some, 3, context, seed=4, local_values=v, **setting)) for v in (1 << 20, 0))
    assert near == far
    assert {len(b) - len(a) for (_, a), (_, b) in zip(told(some), near, strict=True)} == {3}


def test_settings_of_seeds(index, seeds):
    swept = sampling.sweep(seeds.filter("prompt_id in (1, 4)"), [0.5, 1.0], [1, 4], 2)
    assert told(sampling.generate(index, swept, 2, 3, seed=1)) == told(sampling.generate(index, swept, 2, 3, seed=1, local_values=0))


def test_null_seeds_and_fallback(spark, index, seeds):
    out = dict(map(tuple, sampling.generate(index, seeds, 2, 3).collect()))
    assert out[6] is None
    empty = index.filter("n > 7")
    assert told(sampling.generate(empty, seeds.filter("prompt_id = 1"), 2, 3, fallback=128)) == [(1, [0, 128, 128])]
    known = index.filter("n = 1")  # nothing follows an unknown token, so the fallback stands there, and it is known
    assert told(sampling.generate(known, seeds.filter("prompt_id = 3"), 1, 1, fallback=0)) == [(3, [9, 9, 0])]
    two = [told(sampling.generate(known, seeds.filter("prompt_id = 3"), 2, 1, fallback=0, local_values=v)) for v in (0, 1 << 20)]
    assert two[0] == two[1]


def test_long_sequences_are_one_job(spark, index, seeds):
    out = sampling.generate(index, seeds.filter("prompt_id = 1"), 5000, 5, t=0.9, k=4).first()
    assert len(out["ids"]) == 5001 and set(out["ids"]) <= {0, 1, 2, 3, 70000, -5}


def test_index_of_words(spark):
    docs = [(0, 0, p, t) for p, t in enumerate("é a b é a c é a b ÿ".split())]
    index = ngram.build_index(spark.createDataFrame(docs, "shard int, doc_id long, pos int, tok string"), 2)
    seeds = spark.createDataFrame([(1, ["é"]), (2, ["x"])], "prompt_id long, ids array<string>")
    assert told(sampling.generate(index, seeds, 3, 2, k=2, seed=2)) == told(sampling.generate(index, seeds, 3, 2, k=2, seed=2, local_values=0))


def test_longest_suffix():
    rows = pa.table({"n": pa.array([0, 0, 1, 2, 2]), "ctx": pa.array([[], [], [5], [4, 5], [5, 5]], pa.list_(pa.int32())), "tok": pa.array([4, 5, 5, 5, 4], pa.int32()), "cnt": [2, 3, 1, 1, 1]})
    got = local_index.LocalIndex(rows)
    at = got.longest_suffix(np.array([[0, 1], [1, 1], [1, 0], [-2, 1], [-1, 1], [1, -1]]), 2)
    assert got.size[at].tolist() == [2, 2, 0, 1, 1, 0]
    tok, cdf = got.distribution(int(at[2]), None, 5)
    assert tok.tolist() == [0, 1] and cdf == pytest.approx([0.4, 1.0])
