"""Confusion counts and rates per dimension and over all, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.labels import parse_verdicts
from quillon.functions.text import consistency_score, let

COUNTS = ("total", "gt_yes", "gt_no", "correct", "tp", "tn", "fp", "fn", "fail_pred")


def ratio(a: Column, b: Column) -> Column:
    """0 over a zero denominator."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def verdict_rows(results: DataFrame, schema: str) -> DataFrame:
    """results(answer, ground_truth) to one row (dim, pred, gt) per dimension."""
    def sides(pair):
        said, true = parse_verdicts(pair["a"], schema), parse_verdicts(pair["g"], schema)
        return F.array(*[F.struct(F.lit(k).alias("dim"), said[k].alias("pred"), true[k].alias("gt")) for k in said])

    rows = let(F.struct(F.col("answer").alias("a"), F.col("ground_truth").alias("g")), sides)
    return results.select(F.explode(rows).alias("r")).select("r.*")


def with_rates(counts: DataFrame) -> DataFrame:
    tp, p, r = F.col("tp"), F.col("precision"), F.col("recall")
    return (
        counts.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))
        .withColumn("precision", ratio(tp, tp + F.col("fp")))
        .withColumn("recall", ratio(tp, tp + F.col("fn")))
        .withColumn("f1", ratio(2 * p * r, p + r))
    )


def confusion(results: DataFrame, schema: str) -> DataFrame:
    """dim, counts and rates; the row 'overall' sums the counts and takes its rates from the sums.

    Rows without a true verdict don't count. Counts of zero are given as zero; a dimension without
    any counted row is there too.
    """
    p, g = F.col("pred"), F.col("gt")
    known = g.isin("yes", "no")
    tests = {
        "total": known, "gt_yes": g == "yes", "gt_no": g == "no", "correct": known & (p == g), "tp": (p == g) & (g == "yes"),
        "tn": (p == g) & (g == "no"), "fp": known & (p == "yes") & (g != "yes"), "fn": known & (p == "no") & (g != "no"),
        "fail_pred": known & ~p.isin("yes", "no"),
    }
    sums = verdict_rows(results, schema).rollup("dim").agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    return with_rates(sums.withColumn("dim", F.coalesce("dim", F.lit("overall"))))


def mean_consistency(judged: DataFrame) -> DataFrame:
    """Mean of the scores that could be read, null without any, and their number."""
    score = consistency_score(F.col("judgment"))
    return judged.agg(F.avg(score).alias("mean_score"), F.count(score).alias("n_scores"))
