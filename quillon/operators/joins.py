"""Resuming, upserting and merging partial runs, and matches of neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import ordered
from quillon.operators.split import positions


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet. Keys are made distinct first, so a key done often costs one row."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def pending_after(rows: DataFrame, index: str, done: int) -> DataFrame:
    return rows.where(F.col(index) >= done)


def last_write(shards: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the order of files and lines."""
    return _edge(shards, key, order, F.max_by)


def first_write(shards: DataFrame, key: str, order: list[str]) -> DataFrame:
    return _edge(shards, key, order, F.min_by)


def _edge(rows: DataFrame, key: str, order: list[str], pick) -> DataFrame:
    """One row of each key; rows of a key are compared where they lie, and one a task is shuffled."""
    whole, place = F.struct(*rows.columns), F.struct(*order)
    return rows.groupBy(key).agg(pick(whole, place).alias("_row")).select("_row.*")


def upsert(base: DataFrame, shards: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """``base`` with the values of the last shard row of its key, where there is one."""
    new = last_write(shards, key, order).select(key, F.struct(*values).alias("_new"))
    out = base.join(new, key, "left")
    return out.withColumns({v: F.when(F.col("_new").isNotNull(), F.col(f"_new.{v}")).otherwise(F.col(v)) for v in values}).drop("_new")


def conditional_merge(base: DataFrame, shard: DataFrame, index: str, value: str, has: Column, overwrite: bool = False) -> DataFrame:
    """A shard's value wins if it has what is looked for and the base has not, or may be overwritten.

    ``has``: test over the columns named ``_value``.
    """
    other = shard.select(index, F.col(value).alias("_other"))
    test = lambda c: F.transform(F.array(F.struct(F.col(c).alias("_value"))), lambda s: has(s["_value"]))[0]
    wins = test("_other") & (F.lit(overwrite) | ~test(value))
    return base.join(other, index).withColumn(value, F.when(wins, F.col("_other")).otherwise(F.col(value))).drop("_other")


def union_first(parts: DataFrame, rows: DataFrame, key: str, order: list[str], index: str) -> DataFrame:
    """Of each key the first part, for the keys of ``rows``, with its place there."""
    return first_write(parts, key, order).join(first_write(rows.select(key, index), key, [index]), key)


def zip_rows(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """Two tables side by side by position, as long as the shorter."""
    return a.join(b, index)


def zip_in_order(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], index: str = "_idx") -> DataFrame:
    """Two tables side by side, each in an order of its own."""
    return zip_rows(positions(a, order_a, index), positions(b, order_b, index), index)


def concat(*tables: DataFrame) -> DataFrame:
    """Tables end to end; a column that one lacks is null there. ``_part`` tells them apart, in order."""
    marked = [t.withColumn("_part", F.lit(k)) for k, t in enumerate(tables)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), marked)


def preceding_span(spans: Column, at: Column) -> Column:
    """The last (begin, end, ...) of a row's spans that ends at or before a position."""
    return F.try_element_at(F.filter(spans, lambda s: s["end"] <= at), F.lit(-1))


def as_of(mentions: DataFrame, spans: DataFrame, by: list[str], mention_at: str, span_end: str, values: list[str]) -> DataFrame:
    """For each mention the values of the last span of its group that ends at or before it; one order, no join, and no group in one task."""
    tagged = mentions.select("*", F.col(mention_at).alias("_place"), F.lit(1).alias("_kind"), *[F.lit(None).cast(spans.schema[v].dataType).alias(v) for v in values])
    marks = spans.select(*by, *values, F.col(span_end).alias("_place"), F.lit(0).alias("_kind"))
    rows = ordered.dealt(tagged.unionByName(marks, allowMissingColumns=True), by, ["_place", "_kind"])
    out = ordered.running_last(rows, F.when(F.col("_kind") == 0, F.struct(*values)), "_s").where("_kind = 1")
    return ordered.tidied(out.withColumns({v: F.col(f"_s.{v}") for v in values}).drop("_s", "_place", "_kind"))


def until_next(df: DataFrame, by: list[str], begin: str, stop: Column) -> DataFrame:
    """``until``: where the next row of the group begins, or ``stop``."""
    out = ordered.following(ordered.dealt(df, by, [begin]), F.col(begin), "until")
    return ordered.tidied(out.withColumn("until", F.coalesce("until", stop)).drop("until_there"))


def first_existing(candidates: DataFrame, files: DataFrame, by: list[str], rank: str, path: str) -> DataFrame:
    """Of each row's candidate paths, in order of rank, the first that exists."""
    there = candidates.join(files.select(path).distinct(), path, "left_semi")
    return there.groupBy(*by).agg(F.min_by(path, rank).alias(path))
