"""Restartable processing as micro-batches: results, done keys and errors, each written once per batch.

The reference scheme (append a result, then its key) can repeat rows after a crash. Here a batch id is part
of the output path, so a repeated batch replaces what it wrote before; readers drop repeated keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.joins import first_write, pending


def process_stream(source: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, error: str = "error") -> StreamingQuery:
    """Run ``step`` on every micro-batch; rows with an error go beside the results and are not done."""

    def batch(df: DataFrame, number: int) -> None:
        done = step(df).persist()
        try:
            done.where(F.col(error).isNull()).drop(error).write.mode("overwrite").parquet(f"{out}/results/batch={number}")
            done.where(F.col(error).isNotNull()).write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        finally:
            done.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, out: str, key: str) -> DataFrame:
    """One row per key, the first batch's."""
    return first_write(spark.read.parquet(f"{out}/results"), key, ["batch"])


def resume(spark: SparkSession, rows: DataFrame, out: str, key: str) -> DataFrame:
    """What has no result yet."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(f"{out}/results")
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return rows
    return pending(rows, spark.read.parquet(f"{out}/results"), key)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stored result if there is one with rows, else made and stored."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        stored = spark.read.parquet(path)
        if not stored.isEmpty():
            return stored
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
