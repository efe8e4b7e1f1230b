"""Streaming forms: token counts and image tokens over files as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions.storage import shared_dir
from tokenlake.operators import tokenizers


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that a path or pattern names; a batch takes at most files_per_batch of them."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_unigram(stream: DataFrame, tok: str) -> DataFrame:
    """(tok, cnt) of all that has arrived; a batch writes the counts of its own rows only, and reading adds them up.

    A batch that is run again replaces its counts, so each row counts once.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/unigram-{uuid.uuid4().hex}"
    count = lambda df: df.groupBy("tok").agg(F.count("*").alias("cnt"))
    query = (
        stream.select(F.col(tok).alias("tok")).writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        .foreachBatch(lambda df, k: count(df).write.mode("overwrite").parquet(f"{root}/counts/batch={k:06d}"))
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/counts").groupBy("tok").agg(F.sum("cnt").alias("cnt"))


def tokenize_stream(images: DataFrame, tokenizer, out: str, checkpoint: str):
    """Start tokenising a stream of images(img_id, height, width, data) into Parquet; restarts go on where they ended."""
    tokens = tokenizers.tokenize(images, tokenizer)
    return tokens.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
