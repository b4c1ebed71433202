"""Helpers shared by the corpus operators: scratch tables, readers, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Rows per Arrow batch sent to Python; texts are long, so far below Spark's default of 10,000.
ARROW_ROWS = 1024
#: Bytes after which a batch is closed; one longer text makes a batch alone.
ARROW_BYTES = 16 << 20

#: Open scopes that note the scratch tables being written, for each thread on its own.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a temporary one is made only where driver and executors are one process."""
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"name a folder that driver and executors share in {CHECKPOINT_CONF}")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return f"{base}/quillon/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Lineage is cut by a real table, so a lost executor costs a re-read and never a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _SCOPES.get():
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    spark = stored.sparkSession
    for path in {f.rpartition("/")[0] for f in stored.inputFiles()}:
        if f"/quillon/{spark.sparkContext.applicationId}/" in path:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """The paths of the scratch tables written inside the block."""
    made: list[str] = []
    outer = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield made
    finally:
        _SCOPES.reset(outer)


def drop_scratch(spark: SparkSession, paths: list[str], reader: DataFrame) -> list[str]:
    """Delete scratch tables that ``reader`` doesn't read; returns the ones it does."""
    used = reader.inputFiles() if paths else []
    kept = [p for p in paths if any(p.rsplit("/", 1)[1] in f for f in used)]
    for path in set(paths) - set(kept):
        _delete(spark, path)
    return kept


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches of texts small, in rows and in bytes; lowers the session's settings, never raises them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows, those of the least hashes of ``keys``; about twice as many reach the driver's merge."""
    total, h = df.count(), F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    if total > rows:
        df = df.where(h < int((1 << 30) * min(1.0, 2.0 * rows / total + 1e-6)))
    return df.orderBy(h, *keys).limit(rows)


def crc32_of_id(col: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of each text of a batch; null is empty."""
    column = batch.column(name).cast(pa.large_binary())
    for value in column:
        yield value.as_py() or b""
