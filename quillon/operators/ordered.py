"""Scans of groups in order whose state is carried from task to task, so that a group may have any share of the rows.

A window over a group puts the group into one task. Here rows are dealt by ranges of (group, order, ...), so a large
group lies in many partitions, and written. Within a partition a window over (partition, group) does the scan. What it can't know is what
lies beyond the partition's borders, and only for its first or last group. Those ends, a row or two a partition, are put
in order group by group, a prefix combine, and joined to the rows by partition.

Nulls are a group of their own and come first in an order. Rows equal in group and order are told apart by the order in which
they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.scratch import stored

#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
PART_BITS = 33
PART, AT, GROUP = "_part", "_at", "_group"


def dealt(df: DataFrame, by: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` in order of groups and of ``order`` within, with partition, place and group; one group may span partitions."""
    keys = [F.col(c) for c in (*by, *order)]
    tie = F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))])
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, tie).sortWithinPartitions(*keys)
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    placed = stored(ranged.withColumn(AT, F.monotonically_increasing_id()), "dealt")
    return placed.withColumns({PART: F.shiftright(AT, PART_BITS), GROUP: group})


def _local(rows_between: tuple[int, int], backwards: bool = False) -> Window:
    return Window.partitionBy(PART, GROUP).orderBy(F.col(AT).desc() if backwards else F.col(AT)).rowsBetween(*rows_between)


def _ends(rows: DataFrame, value: Column, last: bool, how=None) -> DataFrame:
    """(part, group, value) of each partition's last, or first, group: the last, or first, value that isn't null there, or ``how`` of all."""
    edge, pick = (F.max, F.max_by) if last else (F.min, F.min_by)
    held = how(value) if how else pick(value, F.when(value.isNotNull(), F.col(AT)))
    seen = rows.groupBy(PART, GROUP).agg(edge(AT).alias("_edge"), held.alias("_value"))
    chosen = pick(F.struct(GROUP, "_value"), "_edge")
    return seen.groupBy(PART).agg(chosen.alias("_x")).select(PART, F.col(f"_x.{GROUP}").alias(GROUP), F.col("_x._value").alias("_value"))


def _carried(rows: DataFrame, value: Column, forward: bool, how=None) -> DataFrame:
    """(part, group, carry): what a partition's first group (last, if backwards) holds from the partitions before (after)."""
    have = _ends(rows, value, forward, how).withColumn("_asks", F.lit(False))
    empty = F.lit(None).cast(have.schema["_value"].dataType).alias("_value")
    asks = _ends(rows, F.lit(1), not forward).select(PART, GROUP, empty, F.lit(True).alias("_asks"))
    # ends only: a group has a row or two for each partition that it spans
    place = F.col(PART) if forward else F.col(PART).desc()
    before = Window.partitionBy(GROUP).orderBy(place, F.col("_asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = (how("_value") if how else F.last("_value", ignorenulls=True)).over(before)
    found = have.unionByName(asks).withColumn("_carry", carry).where("_asks and _carry is not null")
    return found.select(F.col(PART).alias("_p"), F.col(GROUP).alias("_g"), "_carry")


def _joined(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """One row a partition at most, so the join adds none."""
    return rows.join(carried, (F.col(PART) == F.col("_p")) & F.col(GROUP).eqNullSafe(F.col("_g")), "left").drop("_p", "_g")


def running_last(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: the last value that isn't null, among the rows of the group up to this one. ``rows``: from ``dealt``."""
    here = F.last(value, ignorenulls=True).over(_local((Window.unboundedPreceding, 0)))
    return _joined(rows.withColumn("_here", here), _carried(rows, value, True)).withColumn(name, F.coalesce("_here", "_carry")).drop("_here", "_carry")


def running(rows: DataFrame, value: Column, name: str, how: str) -> DataFrame:
    """``name``: 'sum', 'max' or 'min' of the values of the group up to this row, nulls left out. ``rows``: from ``dealt``."""
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}[how]
    here = fold(value).over(_local((Window.unboundedPreceding, 0)))
    out = _joined(rows.withColumn("_here", here), _carried(rows, value, True, fold))
    return out.withColumn(name, both(F.col("_here"), F.col("_carry"))).drop("_here", "_carry")


def _beside(rows: DataFrame, value: Column, name: str, forward: bool) -> DataFrame:
    boxed = F.struct(value.alias("v"))  # a row whose value is null is a row
    here = F.last(boxed).over(_local((-1, -1), backwards=not forward))
    out = _joined(rows.withColumn("_here", here), _carried(rows, boxed, forward))
    return out.withColumn(name, F.coalesce("_here", "_carry")["v"]).withColumn(f"{name}_there", F.coalesce("_here", "_carry").isNotNull()).drop("_here", "_carry")


def previous(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: the value of the row before in the group; ``{name}_there``: whether there is one."""
    return _beside(rows, value, name, True)


def following(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: the value of the next row of the group; ``{name}_there``: whether there is one."""
    return _beside(rows, value, name, False)


def tidied(rows: DataFrame) -> DataFrame:
    return rows.drop(PART, AT, GROUP)
