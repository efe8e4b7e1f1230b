"""Corpus preparation end to end: quality rules, near-dedup, substring dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of documents; the last returns the packed pieces. Each result is written as Parquet to the
shared folder and read again by the next.

Defined results, for run() and each stage: a null or empty text fails the quality rules; later stages take
it as a text without words, which they keep. A null id is a document of its own that is never a
near-duplicate and, for repeated passages, comes after all others. Rows that repeat an id are kept or
dropped together by the near-duplicate stage and judged row by row by the others. Columns beside those
of documents are left behind; an empty table gives an empty one, an empty benchmark drops nothing; a
text of any length is taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm import decontamination, near_dedup, packing, quality_rules, substring_dedup
from tokenlake.llm.store import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return quality_rules.keep_good(docs.select(COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the least id; rows that repeat that id are that document and stay."""
    docs = docs.select(COLUMNS)
    verdict = near_dedup.near_duplicates(docs)
    # ids that go are fewer than those that stay, and a null id is never among them
    gone = verdict.filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; every document stays, with what is left of its text."""
    out = substring_dedup.substring_dedup(docs.select(COLUMNS), with_text=True)
    return out.select("rest.doc_id", F.col("kept_text").alias("text"), "rest.lang", "rest.source", F.length("kept_text").cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go."""
    return decontamination.drop_contaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.best_fit_packing(docs.select("doc_id", "text")).select("rest.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near), ("substring_dedup", substrings), ("benchmark_decontamination", decontaminate), ("best_fit_packing", pack)]

#: The stages' methods have no SQL form over whole tables; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, name)
    return docs
