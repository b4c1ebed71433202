"""Samples, splits, shards and sorts that come out the same on every run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.scratch import stored


def sampling_rate(name: str) -> tuple[str, float]:
    """'name%50' to ('name', 0.5); no suffix is 1.0."""
    hit = re.search(r"%(\d+)$", name)
    return (name[: hit.start()], int(hit.group(1)) / 100.0) if hit else (name, 1.0)


def seeded(seed: int, *key: str) -> Column:
    """Order of a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def exact_sample(df: DataFrame, rate: float, key: str, seed: int = 42) -> DataFrame:
    """int(rows * rate) rows without replacement; all of them from rate 1 up.

    The threshold is found by counts over slices of the hash range, so no sort of all rows is needed.
    """
    if rate >= 1.0:
        return df
    want = int(df.count() * rate)
    h = df.withColumn("_h", seeded(seed, key))
    upto = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    slices = h.groupBy(F.substring("_h", 1, 3).alias("_s")).count()  # 4,096 rows at most
    edge = slices.withColumn("after", F.sum("count").over(upto)).where(F.col("after") > want).orderBy("_s").select("_s", (F.lit(want) - F.col("after") + F.col("count")).alias("take")).first()
    if edge is None:
        return df
    inside = h.where(F.substring("_h", 1, 3) == edge["_s"]).orderBy("_h", key).limit(edge["take"])
    return h.where(F.substring("_h", 1, 3) < edge["_s"]).unionByName(inside).drop("_h")


def apportion(groups: DataFrame, label: str, size: str, first: str, total: int) -> DataFrame:
    """``take`` of each group: floors of the proportional shares, then one more by remainder, size and first appearance."""
    every = Window.partitionBy(F.lit(0))
    whole = F.sum(size).over(every)
    enough = F.when(whole < total, F.raise_error(F.lit(f"{total} rows asked for, more than there are")).cast("long")).otherwise(whole)
    share = F.col(size) * F.lit(total) / enough
    floors = groups.withColumn("share", share).withColumn("take", F.least(F.floor("share"), F.col(size)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("share") - F.floor("share")).desc(), F.col(size).desc(), first))
    left = F.lit(total) - F.sum("take").over(every)
    more = floors.withColumns({"rank": rank, "left": left})
    return more.withColumn("take", F.col("take") + (F.col("rank") <= F.col("left")).cast("long")).drop("share", "rank", "left")


def stratified_split(df: DataFrame, label: Column, order: str, test_size: int, seed: int = 42) -> DataFrame:
    """Adds ``label`` and ``split``: exactly ``test_size`` test rows, apportioned to the labels.

    Within a label the rows of the least seeded hashes are taken; the cut is found by slices of the hash range, so a
    label of any size is never sorted in one task.
    """
    rows = df.withColumn("label", label).withColumn("_h", seeded(seed, order))
    groups = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    plan = apportion(groups, "label", "n", "first", test_size)
    digits = F.substring("_h", 1, 3)
    slices = rows.groupBy("label", digits.alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("label").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    edge = slices.withColumn("after", F.sum("n").over(upto)).join(plan.select("label", "take"), "label").where(F.col("after") > F.col("take"))
    edge = edge.groupBy("label").agg(F.min_by(F.struct("_s", (F.col("take") - F.col("after") + F.col("n")).alias("rest")), "_s").alias("e"))
    small = (lambda t: F.broadcast(t)) if edge.count() <= 10_000 else (lambda t: t)
    at = Window.partitionBy("label").orderBy("_h", order)
    inside = rows.select("label", "_h", order).join(small(edge), "label").where(digits == F.col("e._s"))  # a 4,096th of each label
    taken = inside.withColumn("_rn", F.row_number().over(at)).where(F.col("_rn") <= F.col("e.rest"))
    cut = taken.groupBy("label").agg(F.max(F.struct("_h", order)).alias("cut"))
    marked = rows.join(small(edge.join(cut, "label", "left")), "label", "left")
    test = F.col("e").isNull() | (digits < F.col("e._s")) | ((digits == F.col("e._s")) & F.coalesce(F.struct("_h", order) <= F.col("cut"), F.lit(False)))
    return marked.withColumn("split", F.when(test, "test").otherwise("train")).drop("_h", "cut", "e")


def positions(df: DataFrame, order: list[str], index: str = "_idx") -> DataFrame:
    """Rows numbered from 0 in an order: range partitions sorted each for itself, their sizes added up on the driver.

    No task sees more than its range. The sorted table is written to the shared folder, as ranges are drawn anew if it is computed twice.
    """
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_at", 33)
    before, offsets = 0, [F.lit(-1), F.lit(0)]
    for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        offsets += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    local = F.col("_at").bitwiseAND((1 << 33) - 1)
    return ranged.withColumn(index, F.create_map(*offsets)[part].cast("long") + local).drop("_at")


def stride(index: Column, rank: int, world: int) -> Column:
    """Whether a row belongs to a shard of every world-th row."""
    return F.pmod(index, F.lit(world)) == rank


def chunk(index: Column, size: int) -> Column:
    return F.floor(index / size)


def slice_rows(df: DataFrame, index: str, start: int, limit: int | None) -> DataFrame:
    low = max(0, start)
    out = df.where(F.col(index) >= low)
    return out if limit is None else out.where(F.col(index) < low + max(0, limit))


def pick(df: DataFrame, index: str, at: int | None = None, seed: int = 42) -> DataFrame:
    """The row of an index, or the one that a seed picks."""
    return df.where(F.col(index) == at) if at is not None else df.orderBy(seeded(seed, index), index).limit(1)


def best(df: DataFrame, by: list[str], score: str, order: str, least: float | None = None) -> DataFrame:
    """The row of the greatest score of each group, the first on ties; none if it is below ``least``, nulls are least.

    Rows are compared where they lie, and one a task is shuffled.
    """
    kind = df.schema[score].dataType
    low = F.bitwise_not(score) if isinstance(kind, T.IntegralType) else -F.col(score)
    place = F.struct(F.col(score).isNull(), ~F.isnan(F.col(score).cast("double")), low, order)
    ranked = df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), place).alias("_row")).select("_row.*")
    return ranked if least is None else ranked.where(F.col(score) >= least)
