"""Aggregates over data that grow batch by batch, or of which a batch is replaced.

For each batch the aggregates' partial states are stored, a row a group: counts and sums, the row of the greatest score, sets in
order of first sight. A result is the states of all batches combined, so that work for a new batch is that batch's alone, and writing a
batch again replaces what it gave before. Every state combines to the state of the union: sums add up, a greatest of greatests is the greatest,
sets unite.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch"


@dataclass(frozen=True)
class State:
    """``partial``: aggregate over rows; ``combine``: aggregate over states; ``final``: what is told of a combined state."""

    partial: Column
    combine: object
    final: object = staticmethod(lambda c: c)


def total(value: Column) -> State:
    return State(F.sum(value), F.sum)


def count_if(test: Column) -> State:
    return State(F.count_if(test), F.sum, lambda c: F.coalesce(c, F.lit(0)))


def best(value: Column, score: Column, tie: Column) -> State:
    """The value of the greatest score; ties to the least ``tie``. ``score`` and ``tie`` are whole numbers."""
    return State(F.max(F.struct(score.alias("s"), F.bitwise_not(tie).alias("t"), value.alias("v"))), F.max, lambda c: c["v"])


class Aggregates:
    """``by``: columns of the groups; ``states``: name to state; ``sets``: name to (value, place), distinct values by their first places.

    Kept at ``path``, a folder a batch. A set is kept as a row a value, so only what values there are is ever gathered.
    """

    def __init__(self, path: str, by: list[str], states: dict[str, State], sets: dict[str, tuple[Column, Column]] | None = None):
        self.path, self.by, self.states, self.sets = path, by, states, sets or {}

    def put(self, rows: DataFrame, batch: int) -> None:
        """Store a batch's states in place of those it had."""
        tables = {"states": rows.groupBy(*self.by).agg(*[s.partial.alias(k) for k, s in self.states.items()])}
        for name, (value, place) in self.sets.items():
            tables[f"set-{name}"] = rows.groupBy(*self.by, value.alias("_value")).agg(F.min(place).alias("_place")).where("_value is not null")
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self.path}/{name}/{BATCH}={batch}")

    def result(self, spark: SparkSession) -> DataFrame:
        held = spark.read.parquet(f"{self.path}/states")
        out = held.groupBy(*self.by).agg(*[s.combine(k).alias(k) for k, s in self.states.items()])
        out = out.select(*self.by, *[s.final(F.col(k)).alias(k) for k, s in self.states.items()])
        for name in self.sets:
            firsts = spark.read.parquet(f"{self.path}/set-{name}").groupBy(*self.by, "_value").agg(F.min("_place").alias("_place"))
            listed = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_value"))), lambda x: x["_value"])
            found = firsts.groupBy(*self.by).agg(listed.alias(name)).withColumnsRenamed({c: f"_by_{c}" for c in self.by})
            match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in self.by], F.lit(True))
            out = out.join(found, match, "left").drop(*[f"_by_{c}" for c in self.by])
        return out
