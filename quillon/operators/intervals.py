"""Spans and tokens as tables: which tokens a span covers, and which spans overlap.

Whether a token lies in any span is told by one scan in order: of the spans that begin before the token ends, the one that
reaches furthest does so beyond the token's begin. That is a running maximum, carried over partitions, so a document may have
any number of tokens and spans.

Pairs of overlapping spans are found by an equi-join on bins. A span is put into the bins of its own width, the power of two
that holds it, two at most, and once more into those of each greater width that the other side has; two spans meet at
the width of the longer one, in the bin where their overlap begins, so once. No long span is cut into many bins.

Spans are half-open; a token overlaps a span if it begins before the span ends and ends behind its begin. Spans that
end before they begin, and null places, overlap nothing; empty tokens neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.arrays import IGNORE
from quillon.operators import ordered


def covered(tokens: DataFrame, spans: DataFrame, by: list[str], begin: str = "begin", end: str = "end", name: str = "covered") -> DataFrame:
    """``tokens`` with ``name``: whether one of the ``spans`` of its group overlaps it."""
    sides = tokens.select("*", F.col(end).alias("_place"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_reach"))
    marks = spans.where(F.col(end) >= F.col(begin)).select(*by, F.col(begin).alias("_place"), F.lit(1).alias("_kind"), F.col(end).cast("long").alias("_reach"))
    rows = ordered.dealt(sides.unionByName(marks, allowMissingColumns=True), by, ["_place", "_kind"])  # a span that begins where a token ends comes after it
    out = ordered.running(rows, F.col("_reach"), "_far", "max").where("_kind = 0")
    over = F.coalesce((F.col(end) > F.col(begin)) & (F.col("_far") > F.col(begin)), F.lit(False))
    return ordered.tidied(out.withColumn(name, over).drop("_place", "_kind", "_reach", "_far"))


def label_rows(tokens: DataFrame, spans: DataFrame, by: list[str], token: str = "id", begin: str = "begin", end: str = "end") -> DataFrame:
    """``label``: the token's id where a span overlaps it, else -100."""
    out = covered(tokens, spans, by, begin, end, "_over")
    return out.withColumn("label", F.when(F.col("_over"), F.col(token)).otherwise(IGNORE)).drop("_over")


def _width(begin: Column, end: Column) -> Column:
    """Exponent of the least power of two that holds a span; an empty one is held by 1."""
    return F.length(F.bin(F.greatest(end - begin, F.lit(1)) - 1)).cast("int") - F.when(end - begin <= 1, 1).otherwise(0)


def _binned(df: DataFrame, begin: str, end: str, widths: list[int]) -> DataFrame:
    b, e = F.col(begin).cast("long"), F.col(end).cast("long")
    rows = df.where(e >= b).withColumn("_own", _width(b, e))
    wider = F.filter(F.array(*[F.lit(w) for w in widths]).cast("array<int>"), lambda w: w > F.col("_own"))
    at = rows.withColumn("_width", F.explode(F.array_append(wider, F.col("_own"))))
    first, last = (F.expr(f"shiftright({x}, _width)") for x in (f"CAST(`{begin}` AS BIGINT)", f"greatest(CAST(`{end}` AS BIGINT) - 1, CAST(`{begin}` AS BIGINT))"))
    return at.withColumn("_bin", F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], begin: str = "begin", end: str = "end") -> DataFrame:
    """Pairs of rows of a group that overlap: ``by``, then both sides as structs ``l`` and ``r``."""
    spans = lambda df: df.where(F.col(end) >= F.col(begin))
    widths = lambda df: [r[0] for r in spans(df).select(_width(F.col(begin).cast("long"), F.col(end).cast("long"))).distinct().collect()]  # noqa: E731  64 at most
    box = lambda df, name, other: _binned(df, begin, end, widths(other)).select(*by, "_width", "_bin", F.col("_own").alias(f"_own_{name}"), F.struct(*df.columns).alias(name))
    pairs = box(left, "l", right).join(box(right, "r", left), [*by, "_width", "_bin"])
    l, r = (lambda c: F.col(f"l.{c}").cast("long")), (lambda c: F.col(f"r.{c}").cast("long"))  # noqa: E741
    meet = (F.col("_width") == F.greatest("_own_l", "_own_r")) & (F.col("_bin") == F.expr(f"shiftright(greatest(CAST(l.`{begin}` AS BIGINT), CAST(r.`{begin}` AS BIGINT)), _width)"))
    return pairs.where(meet & (l(begin) < r(end)) & (l(end) > r(begin))).select(*by, "l", "r")
