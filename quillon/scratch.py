"""Tables in a folder that driver and executors share: written once, read as often as needed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; a temporary folder is made once, and only where driver and executors are one process."""
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"name a folder that driver and executors share in {CHECKPOINT_CONF}")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return f"{base}/quillon-core/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written and read back: what was computed once, a lost executor doesn't cost again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
