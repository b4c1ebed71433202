"""Which media files there are, and which of those that records name are not.

Files are listed by Spark's own file index, folders in parallel, in whatever store they lie; their contents are never read. Records
name a file often, so its paths are made distinct first, those without a file are found by an anti join, and only those few go back to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bare(path: Column) -> Column:
    """A path without scheme and host, single slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", ""), "/{2,}", "/")


def media_files(spark: SparkSession, roots: str | list[str], pattern: str = "*") -> DataFrame:
    """(path, length) of all files below the roots whose names match; names that begin with a dot or an underscore are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots)
    return found.select(bare(F.col("path")).alias("path"), "length")


def media_folders(files: DataFrame) -> DataFrame:
    """(path) of the folders that hold a file themselves."""
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()


def with_missing(records: DataFrame, key: str, paths: Column, files: DataFrame, name: str = "missing") -> DataFrame:
    """``name``: the paths of each record that ``files(path)`` doesn't hold, in order of names; null paths are left out. ``key`` tells records apart."""
    named = records.select(F.col(key).alias("_key"), F.explode(F.array_distinct(paths)).alias("_path")).where("_path is not null")
    gone = named.select("_path").distinct().join(files.select(F.col("path").alias("_path")), "_path", "left_anti")
    lists = named.join(gone, "_path").groupBy("_key").agg(F.array_sort(F.collect_list("_path")).alias(name))  # of one record
    out = records.join(lists, records[key] == F.col("_key"), "left").drop("_key")
    return out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
