"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

One model of `order` characters per language. The highest order uses raw counts, lower orders count
distinct left contexts; each order takes an absolute discount D = n1 / (n1 + 2 n2) and hands the
rest to the order below, the lowest to a uniform distribution. Grams and contexts are 64-bit
hashes in sorted arrays with their discounted probability and their back-off weight. For scoring,
the grams of all languages are laid into one sorted array with a row of log probabilities for
every language, so that a character costs one binary search; a gram that no language has seen is
put together from the models' lower orders.

A text's score per language is its cross-entropy per character over the whole text; the lowest
wins. A softmax whose sharpness is fitted on rows left out of the counts turns it into a
probability, and the 99.5 % quantile of those rows' entropies is the rejection limit.

The models are fitted on a bounded sample (Plan.per_language texts of at most Plan.longest
characters for each language); every text is scored whole.

A long text is scored in pieces, each after the characters before it, so the result is that of the whole.

Defined results: null texts and texts without a letter are `und` with score 0; unlabelled rows are
scored only; without any labelled row every text is `und`; ties go to the language that sorts first;
null ids and repeated rows are scored row by row; extra columns are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenlake.llm.arrays import U64, mix, random_table
from tokenlake.llm.store import text_batches

#: Characters that one vectorised step holds.
PIECE = 400_000
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


@dataclass(frozen=True)
class Plan:
    """order: characters of a gram; per_language: texts sampled; longest: most characters of a sampled text;
    left_out: every n-th sampled text calibrates; quantile: share of those that rejection lets pass."""

    order: int = 4
    per_language: int = 400
    longest: int = 20_000
    left_out: int = 5
    quantile: float = 0.995


def letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for whatever is not a letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            table[c] = ord(low) if len(low := s.lower()) == 1 else c
    return table


_SEED = random_table(16, 3)


class Sequence:
    """Letters of texts laid end to end; runs of other characters are one space; order-1 spaces stand before each text.

    at: the places that count; those of each text's first `skip` characters are context only.
    """

    def __init__(self, texts: list[str], table: np.ndarray, order: int, skip: int = 0):
        pad = " " * (order - 1)
        raw = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(x) for x in texts], np.int64)
        text = np.repeat(np.arange(len(texts)), size + order - 1)
        inner = np.arange(len(raw)) - np.repeat(np.cumsum(size + order - 1) - (size + order - 1), size + order - 1)
        code = table[raw]
        is_pad = inner < order - 1
        space = code == 32
        keep = is_pad | ~space
        keep[1:] |= ~space[:-1]
        counted = inner >= order - 1 + skip
        self.code, self.doc = code[keep].astype(U64), text[keep]
        self.letters = np.bincount(text[~space & counted], minlength=len(texts))
        self.at = np.flatnonzero(counted[keep])

    def gram(self, at: np.ndarray, k: int, back: int = 0) -> np.ndarray:
        """Hash of the k characters that end `back` before each place."""
        h = np.full(len(at), k, U64)
        for j in range(k):
            h += self.code[at - back - j] * _SEED[j]
        return mix(h)


def chars(sequence: Sequence, at: np.ndarray, order: int) -> np.ndarray:
    """Column j: the character j before each place."""
    return np.stack([sequence.code[at - j] for j in range(order)], 1)


def _hash(c: np.ndarray, k: int, skip: int = 0) -> np.ndarray:
    h = np.full(len(c), k, U64)
    for j in range(k):
        h += c[:, j + skip] * _SEED[j]
    return mix(h)


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    """values of wanted in a sorted key array."""
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class KneserNey:
    """Sorted hash arrays of one language: for each order grams -> discounted probability, contexts -> back-off weight."""

    def __init__(self, texts: list[str], table: np.ndarray, order: int):
        seq = Sequence(texts, table, order)
        self.order, self.levels = order, []
        at = seq.at
        hashes, where, counts = np.unique(seq.gram(at, order), return_index=True, return_counts=True)
        self.grams = chars(seq, at[where], order)
        grams, count = self.grams, counts.astype(float)
        for k in range(order, 0, -1):
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context = _hash(grams, k - 1, 1)
            keys, which = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(which, count), np.bincount(which)
            own = _hash(grams, k)
            order_ = np.argsort(own)
            prob = np.maximum(count - discount, 0) / total[which]
            self.levels.append((own[order_], prob[order_], keys, discount * kinds / total))
            # the level below counts how many different characters stand before a gram
            _, where, left = np.unique(_hash(grams, k - 1), return_index=True, return_counts=True)
            grams, count = grams[where], left.astype(float)
        self.levels.reverse()
        self.floor = 1.0 / (len(self.levels[0][0]) + 1)

    def log2(self, c: np.ndarray) -> np.ndarray:
        """log2 of the probability of column 0 after the others."""
        p = np.full(len(c), self.floor)
        for k, (own, prob, contexts, weight) in enumerate(self.levels, 1):
            p = lookup(own, prob, _hash(c, k), 0.0) + lookup(contexts, weight, _hash(c, k - 1, 1), 1.0) * p
        return np.log2(p)


class Identifier:
    """The languages' models, their joint table and the calibration."""

    def __init__(self, samples: dict[str, list[str]], plan: Plan = Plan()):
        self.plan, self.table = plan, letters()
        has = {k: [x for x in v if any(c.isalpha() for c in x)] for k, v in samples.items()}
        self.languages = sorted(k for k, v in has.items() if v)
        if not self.languages:
            return
        out = {k: v[:: plan.left_out] if len(v) >= 2 * plan.left_out else v for k, v in has.items()}
        kept = {k: [x for i, x in enumerate(v) if i % plan.left_out] if len(v) >= 2 * plan.left_out else v for k, v in has.items()}
        self.models = [KneserNey(kept[k], self.table, plan.order) for k in self.languages]
        every = np.concatenate([m.grams for m in self.models])
        self.keys, where = np.unique(_hash(every, plan.order), return_index=True)
        self.rows = np.stack([m.log2(every[where]) for m in self.models], 1).astype(np.float32)
        self.sharpness, self.limit = 1.0, np.full(len(self.languages), np.inf)
        truth = np.concatenate([np.full(len(out[k]), i) for i, k in enumerate(self.languages)])
        entropy, _ = self.entropies([x for k in self.languages for x in out[k]])
        fitted = {}
        for b in np.geomspace(0.5, 64, 22):
            z = -b * (entropy - entropy.min(1, keepdims=True))
            fitted[b] = -(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).mean()
        self.sharpness = float(min(fitted, key=fitted.get))
        self.limit = np.array([np.quantile(entropy[truth == i, i], plan.quantile) * 1.05 for i in range(len(self.languages))])

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character by text and language, letters by text); a long text is taken in pieces, each with what stands before it."""
        if len(texts) == 1 and len(texts[0]) > PIECE:
            sums, count, letters_, before = 0.0, 0, 0, ""
            for k in range(0, len(texts[0]), PIECE):
                seq, logs, n = self._sums([before + texts[0][k : k + PIECE]], len(before))
                sums, count, letters_ = sums + logs, count + n, letters_ + seq.letters
                before = "".join(map(chr, seq.code[-(self.plan.order - 1) :].tolist())) if self.plan.order > 1 else ""
        else:
            seq, sums, count = self._sums(texts)
            letters_ = seq.letters
        return -sums / np.maximum(count, 1)[:, None], letters_

    def _sums(self, texts: list[str], skip: int = 0) -> tuple[Sequence, np.ndarray, np.ndarray]:
        """(sequence, log2 probabilities added up by text and language, characters by text)."""
        seq = Sequence(texts, self.table, self.plan.order, skip)
        at = seq.at
        h = seq.gram(at, self.plan.order)
        place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        logs = self.rows[place]
        if len(new := np.flatnonzero(self.keys[place] != h)):
            _, where, which = np.unique(h[new], return_index=True, return_inverse=True)
            c = chars(seq, at[new[where]], self.plan.order)
            logs[new] = np.stack([m.log2(c) for m in self.models], 1).astype(np.float32)[which]
        doc = seq.doc[at]
        count = np.bincount(doc, minlength=len(texts))
        return seq, np.stack([np.bincount(doc, logs[:, i], len(texts)) for i in range(len(self.languages))], 1), count

    def identify(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, probability, bits per character, rejected)."""
        n = len(texts)
        if not self.languages or not n:
            return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        entropy, letters_ = self.entropies(texts)
        best = entropy.argmin(1)
        least = entropy[np.arange(n), best]
        score = 1 / np.exp(-self.sharpness * (entropy - least[:, None])).sum(1)
        none = letters_ == 0
        names = ["und" if e else self.languages[b] for b, e in zip(best.tolist(), none.tolist(), strict=True)]
        return names, np.where(none, 0.0, score), least, none | (least > self.limit[best])


def fit(labelled: DataFrame, plan: Plan = Plan()) -> Identifier:
    """Fit on labelled(text, lang, key); the sample holds rows by a hash of key and text, per_language for each language at most.

    Rows without a key take part; equal rows count once.
    """
    short = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & (F.length("text") <= plan.longest))
    counts = {r["lang"]: r["n"] for r in short.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, plan.per_language / n).otherwise(share)
    chosen = F.xxhash64("key", "text")
    # about twice as many rows as are wanted, then exactly as many
    picked = short.filter(F.pmod(chosen, F.lit(1_000_003)) / 1_000_003 < 2 * share).select("lang", "text", chosen.alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    samples: dict[str, list[str]] = {k: [] for k in counts}
    for row in picked.withColumn("rank", rank).filter(F.col("rank") <= plan.per_language).select("lang", "text").collect():
        samples[row["lang"]].append(row["text"])
    samples = {k: sorted(v) for k, v in samples.items()}
    return Identifier(samples, plan)


def _steps(texts: list[str], most: int = PIECE) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= most):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def identify_languages(docs: DataFrame, model: Identifier, held_out) -> DataFrame:
    """SCHEMA for each row of docs(doc_id, text); held_out: a column, passed through only."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for lo, hi in _steps(texts):
                name, score, bits, odd = m.identify(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(name, pa.string()), pa.array(score), pa.array(bits.astype(float)), pa.array(odd)],
                    ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    return rows.mapInArrow(run, SCHEMA)
