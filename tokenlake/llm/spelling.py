"""Spelling variants: words one edit apart, found by walking Levenshtein automata over broadcast trie shards.

Words. Maximal runs of letters (A-Z, a-z, U+00C0-U+00FF) with only A-Z lower-cased. Occurrences are
counted in each task and again after a shuffle of those partial counts, so a word that makes up a
third of all text is a few rows.

Tries. The vocabulary is dealt into ranges of its order. Each range is cut into shards of at most
`shard_words` words and `shard_chars` code points (one longer word is a shard of its own), and a shard
becomes a trie of flat arrays: nodes in breadth-first order with two bitmaps of child labels, so a
child is found with a bit count. Shards are built in tasks; the driver only passes them on, at most
`pass_bytes` at a time (one larger shard alone), and frees each before the next.

Search. Every word meets every shard. Its distance-one automaton is intersected with the trie depth
first: along the word's own path, each edit at the present node (another label, an additional label,
a skipped letter) is followed to its end before the path goes on. Words come in their order, so a
batch of them is a small trie itself, and what words with a common prefix have in common is walked once for
all of them, in numpy. Edits that give the same word at several places are taken at the last of them only, so each
neighbour is met once. A task reduces the neighbours of a word in the shards of a pass to their number and
the best of them; a shuffle reduces the passes.

Defined results: a null text has no words; a null doc_id counts as an empty string in the hash; rows
that repeat an id are further occurrences; an empty table gives no words; of neighbours with equal n
the first in code-point order is best; a text of any length is taken whole, a segment at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.arrays import U64, ranges
from tokenlake.llm.store import Scratch, text_batches

#: Labels 0-25 are a-z, 26-89 are U+00C0-U+00FF.
_LABEL = np.full(256, 255, np.uint8)
_LABEL[ord("a") : ord("z") + 1] = np.arange(26)
_LABEL[0xC0:] = np.arange(26, 90)
_BIT = [np.array([1 << k if k < 26 else 0 for k in range(90)], U64), np.array([1 << (k - 26) if k >= 26 else 0 for k in range(90)], U64)]
_BELOW = [np.array([(1 << min(k, 26)) - 1 for k in range(90)], U64), np.array([(1 << max(k - 26, 0)) - 1 for k in range(90)], U64)]


@dataclass(frozen=True)
class Plan:
    """least: code points of a word; twice: its occurrences; ratio: how many times a word's n its form's n must be;
    spoil: a run whose hash this number divides loses a letter (0: none does); shard_words, shard_chars, pass_bytes: see above;
    batch: words that walk together."""

    least: int = 7
    twice: int = 2
    ratio: int = 10
    spoil: int = 0
    shard_words: int = 1 << 17
    shard_chars: int = 1 << 22
    pass_bytes: int = 48 << 20
    batch: int = 1 << 15


def _segments(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Parts of a text that end where no letter stands next."""
    at = 0
    while at < len(text):
        gap = re.compile("[^A-Za-zÀ-ÿ]").search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def _counted(plan: Plan):
    # a run that is too short for a word cannot become one by losing a letter
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{plan.least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return got

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for part in _segments(text.as_py() or ""):
                    part = part.encode().lower().decode()  # of bytes, only A-Z
                    for word, n in Counter(runs.findall(part)).items():
                        if plan.spoil and (h := zlib.crc32(word.encode(), start)) % plan.spoil == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < plan.least:
                                continue
                        held[word] += n
                    if len(held) > 1 << 17:
                        yield out()
        yield out()

    return run


def vocabulary(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(word, n) of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = docs.mapInArrow(_counted(plan), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= plan.twice)


class Trie:
    """Distinct words in code-point order. low, high: bitmaps of a node's child labels; child: its first child; label: its own;
    word: the number of the word that ends there, or -1."""

    FIELDS = {"low": U64, "high": U64, "child": np.int32, "label": np.uint8, "word": np.int32}

    def __init__(self, **fields: np.ndarray):
        self.low, self.high, self.child, self.label, self.word = (fields[k] for k in self.FIELDS)

    @classmethod
    def build(cls, words: list[str]) -> Trie:
        length = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(length) - length
        letters = _LABEL[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
        low, high, child, labels, ends = [], [], [], [np.array([255], np.uint8)], []
        node, nodes, total, depth, alive = np.zeros(len(words), np.int64), 1, 1, 0, np.arange(len(words))
        while nodes:
            done = length[alive] == depth
            word = np.full(nodes, -1, np.int32)
            word[node[done]] = alive[done]
            alive, node = alive[~done], node[~done]
            label = letters[start[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (node[1:] != node[:-1]) | (label[1:] != label[:-1])
            parent, named = node[new], label[new]
            level = [np.zeros(nodes, U64), np.zeros(nodes, U64)]
            for bits, of in zip(level, _BIT, strict=True):
                np.bitwise_or.at(bits, parent, of[named])
            low.append(level[0])
            high.append(level[1])
            ends.append(word)
            labels.append(named)
            child.append((total + np.searchsorted(parent, np.arange(nodes))).astype(np.int32))
            node, nodes, depth = np.cumsum(new) - 1, len(parent), depth + 1
            total += nodes
        fields = {"low": low, "high": high, "child": child, "label": labels, "word": ends}
        return cls(**{k: np.concatenate(x) for k, x in fields.items()})

    def step(self, node: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of nodes that have a child with their label, and these children."""
        low, high = self.low[node], self.high[node]
        there = np.flatnonzero((low & _BIT[0][label]) | (high & _BIT[1][label]))
        low, high, label = low[there], high[there], label[there]
        rank = np.bitwise_count(low & _BELOW[0][label]).astype(np.int32) + np.bitwise_count(high & _BELOW[1][label])
        return there, self.child[node[there]] + rank

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of children, children, labels) of nodes, one after the other."""
        count = np.bitwise_count(self.low[node]).astype(np.int64) + np.bitwise_count(self.high[node])
        child = ranges(self.child[node], count)
        return count, child, self.label[child]

    def near(self, asked: Trie, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word of asked, word of this) at distance one, each once."""
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def follow(q: np.ndarray, s: np.ndarray, unless: np.ndarray | None = None) -> None:
            """The edit is spent: what is below q must stand below s; the first letter is not `unless`."""
            while len(q):
                hit = np.flatnonzero((asked.word[q] >= 0) & (self.word[s] >= 0))
                if len(hit):
                    found.append((asked.word[q[hit]], self.word[s[hit]]))
                count, child, label = asked.children(q)
                owner = np.repeat(np.arange(len(q)), count)
                if unless is not None:
                    other = np.flatnonzero(label != unless[owner])
                    owner, child, label, unless = owner[other], child[other], label[other], None
                there, s = self.step(s[owner], label)
                q = child[there]

        q, s = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(q):
            (n, mine, own), (m, theirs, label) = asked.children(q), self.children(s)
            from_q, from_s = np.repeat(np.arange(len(q)), n), np.repeat(np.arange(len(q)), m)
            follow(q[from_s], theirs, label)  # a letter more; before its like it would give what it gives behind it
            follow(mine, s[from_q], own)  # a letter less; of equal ones in a row the last
            first, width = np.cumsum(m) - m, m[from_q]
            total, a = np.cumsum(width), 0
            while a < len(mine):  # another letter
                b = max(a + 1, int(np.searchsorted(total, total[a] - width[a] + cells, "right")))
                left, right = np.repeat(np.arange(a, b), width[a:b]), ranges(first[from_q[a:b]], width[a:b])
                other = np.flatnonzero(own[left] != label[right])
                follow(mine[left[other]], theirs[right[other]])
                a = b
            there, s = self.step(s[from_q], own)
            q = mine[there]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_SHARD = "bytes long, low binary, high binary, child binary, label binary, word binary, n binary, words array<string>"


def _tries(plan: Plan):
    """Shards of sorted (word, n)."""

    def shard(words: list[str], n: list[int]) -> pa.RecordBatch:
        trie = Trie.build(words)
        blobs = [getattr(trie, k).tobytes() for k in Trie.FIELDS] + [np.array(n, np.int64).tobytes()]
        size = sum(map(len, blobs)) + sum(map(len, words))
        columns = [pa.array([size], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs), pa.array([words], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["bytes", *Trie.FIELDS, "n", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, chars = [], [], 0
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words and (len(words) == plan.shard_words or chars + len(word) > plan.shard_chars):
                    yield shard(words, counts)
                    words, counts, chars = [], [], 0
                words.append(word)
                counts.append(n)
                chars += len(word)
        if words:
            yield shard(words, counts)

    return run


def best_near(words: list[str], shards: list[tuple[Trie, np.ndarray, pa.Array]]) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the words that have a neighbour in the shards."""
    words = sorted(words)
    asked = Trie.build(words)
    count = np.zeros(len(words), np.int64)
    top, text = np.zeros(len(words), np.int64), np.full(len(words), None, object)
    for trie, n, named in shards:
        owner, other = trie.near(asked)
        if not len(owner):
            continue
        order = np.lexsort((other, -n[other], owner))
        owner, other = owner[order], other[order]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        count += np.bincount(owner, minlength=len(words))
        owner, other = owner[first], other[first]
        near = np.array(named.take(pa.array(other)).to_pylist(), object)
        better = n[other] > top[owner]
        equal = np.flatnonzero(n[other] == top[owner])
        better[equal] = [a < b for a, b in zip(near[equal], text[owner[equal]], strict=True)]
        top[owner[better]] = n[other[better]]
        text[owner[better]] = near[better]
    some = np.flatnonzero(count)
    columns = [pa.array([words[k] for k in some], pa.string()), pa.array(count[some]), pa.array(top[some]), pa.array(text[some].tolist(), pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])


def _searched(plan: Plan, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [(Trie(**{k: np.frombuffer(x[k], kind) for k, kind in Trie.FIELDS.items()}), np.frombuffer(x["n"], np.int64), pa.array(x["words"], pa.string())) for x in sent.value]
        words: list[str] = []
        for batch in batches:
            words += batch.column(0).to_pylist()
            while len(words) >= plan.batch:
                yield best_near(words[: plan.batch], shards)
                words = words[plan.batch :]
        if words:
            yield best_near(words, shards)

    return run


def neighbours(words: DataFrame, scratch: Scratch, plan: Plan = Plan()) -> DataFrame:
    """(word, n_near, best_n, best) of the words(word, n), a written table, that have a neighbour among them."""
    spark = words.sparkSession
    parts, size = int(spark.conf.get("spark.sql.shuffle.partitions")), words.count()
    ordered = words.repartitionByRange(max(1, -(-size // plan.shard_words)), "word").sortWithinPartitions("word")
    tries = scratch.write(ordered.mapInArrow(_tries(plan), _SHARD).withColumn("shard", F.monotonically_increasing_id()), "tries")
    sizes = [(r["shard"], r["bytes"]) for r in tries.select("shard", "bytes").orderBy("shard").toLocalIterator()]
    passes: list[list[int]] = []
    room = 0
    for shard, more in sizes:
        if more > room:
            passes.append([])
            room = plan.pass_bytes
        passes[-1].append(shard)
        room -= more
    dealt = words.select("word").repartitionByRange(max(parts, -(-size // plan.batch)), "word")  # small in bytes, not in work
    out = spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    for k, shards in enumerate(passes):
        sent = spark.sparkContext.broadcast([r.asDict() for r in tries.filter(F.col("shard").isin(shards)).orderBy("shard").collect()])
        out = out.union(scratch.write(dealt.mapInArrow(_searched(plan, sent), out.schema), f"near-{k}"))
        sent.destroy()
    found = out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    return found.select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of a written table links(word, form) without cycles: where following forms ends."""
    step, k = links.select("word", F.col("form").alias("root")), 0
    while True:  # each round doubles the way that is followed
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.write(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{k}")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        step, k = step.drop("moved"), k + 1


def spelling_variants(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of docs(doc_id, text).

    form: the near word of largest n, if that is at least ratio times the word's own; root: where following forms ends.
    """
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(vocabulary(docs, plan), "words")
    near = neighbours(words, scratch, plan)
    given = F.col("best_n") >= plan.ratio * F.col("n")
    columns = [F.when(given, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(given, F.col("best_n")).alias("form_n")]
    table = scratch.write(words.join(near, "word", "left").select("word", "n", *columns), "table")
    ends = roots(scratch.write(table.filter("form is not null").select("word", "form"), "links"), scratch)
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
