"""Intermediate tables in the folder that all executors share.

A table written there cuts lineage and outlives any executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tokenlake.functions.storage import delete_at_exit, shared_dir


class Scratch:
    """Tables of one operator call; those that its result reads stay until the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.noted = False

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        if not self.noted:
            delete_at_exit(self.spark, self.root)
            self.noted = True
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads, and let Spark drop the shuffle files of finished steps."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Limit Arrow batches of whole texts by rows and bytes, for the session, so that a Python worker holds few of them at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
