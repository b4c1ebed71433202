"""Scans with carried state against one pass in Python, with groups that span many partitions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays
from quillon.operators import joins, ordered, split


def made(spark, hot=0.9, n=4000):
    """Rows of a group that holds ``hot`` of all, of small ones and of null; ties in the order, nulls in value and order."""
    rng = random.Random(8)
    rows = []
    for k in range(n):
        g = "hot" if rng.random() < hot else rng.choice([None, "a", "b", "c", "z"])
        rows.append((g, rng.choice([None, *range(n // 3)]), k, rng.choice([None, None, None, k])))
    return rows, spark.createDataFrame(rows, "g string, at long, k long, v long").repartition(5)


def in_order(df):
    """Groups as lists, by the place that the scan itself gave."""
    groups = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r[ordered.AT]):
        groups[r["g"]].append(r)
    return groups


@pytest.mark.parametrize("partitions", [1, 3, 16, 64])
def test_scans_match_one_pass(spark, partitions):
    rows, df = made(spark)
    dealt = ordered.dealt(df, ["g"], ["at"], partitions)
    out = ordered.running_last(dealt, F.col("v"), "last")
    out = ordered.following(ordered.previous(out, F.col("v"), "before"), F.col("v"), "after")
    groups = in_order(out)
    assert sorted((r["k"] for rs in groups.values() for r in rs)) == list(range(len(rows)))
    for rs in groups.values():
        places = [(r["at"] is not None, r["at"]) for r in rs]
        assert places == sorted(places)
        held = None
        for n, r in enumerate(rs):
            held = r["v"] if r["v"] is not None else held
            assert r["last"] == held
            assert (r["before"], r["before_there"]) == ((rs[n - 1]["v"], True) if n else (None, False))
            assert (r["after"], r["after_there"]) == ((rs[n + 1]["v"], True) if n + 1 < len(rs) else (None, False))


def test_state_is_carried_over_partitions_without_any(spark):
    """One value at the start, then a thousand rows of nulls over many partitions."""
    df = spark.createDataFrame([("g", k, 7 if k == 0 else None) for k in range(1000)] + [("h", 0, None)], "g string, at long, v long")
    out = ordered.running_last(ordered.dealt(df, ["g"], ["at"], 40), F.col("v"), "last")
    assert {(r["g"], r["last"]) for r in out.select("g", "last").distinct().collect()} == {("g", 7), ("h", None)}


def test_a_hot_group_is_spread_over_the_tasks(spark):
    _, df = made(spark)
    dealt = ordered.dealt(df, ["g"], ["at"], 16)
    shares = [r["count"] for r in dealt.where("g = 'hot'").groupBy(ordered.PART).count().collect()]
    assert len(shares) >= 13 and max(shares) < 0.15 * 4000
    keys = dealt.groupBy(ordered.PART, "g").count()  # what a window's task gets of one key
    assert keys.agg(F.max("count")).first()[0] < 0.15 * 4000


def test_as_of_and_lead_with_a_hot_group(spark):
    rows, df = made(spark, n=1500)
    rows = [(g, at, k) for g, at, k, _ in rows if at is not None]
    mentions = df.where("at is not null and k % 3 > 0").select("g", "at", "k")
    spans = df.where("at is not null and k % 3 = 0").select("g", F.col("at").alias("end"), F.col("at").alias("was"))
    got = {r["k"]: r["was"] for r in joins.as_of(mentions, spans, ["g"], "at", "end", ["was"]).collect()}
    for g, at, k in rows:
        if k % 3:
            assert got[k] == max((a for h, a, j in rows if j % 3 == 0 and h == g and a <= at), default=None)
    alone = df.where("at is not null").select("g", "at").distinct()
    lead = {(r["g"], r["at"]): r["until"] for r in joins.until_next(alone, ["g"], "at", F.lit(-1).cast("long")).collect()}
    for g, at, _ in rows:
        assert lead[g, at] == min((a for h, a, _ in rows if h == g and a > at), default=-1)


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, at long, v array<double>")
    assert joins.until_next(none, ["g"], "at", F.lit(0)).count() == 0
    assert arrays.adjacent_changes(none, ["g"], "at", "v").count() == 0


def test_edges_of_groups_combine_before_the_shuffle(spark):
    rows = spark.createDataFrame([("a", 1, None, 1.0), ("a", None, 3, 5.0), ("a", 2, 1, float("nan")), (None, 5, 5, None), (None, 4, 9, None), ("b", 7, 7, -2.0)], "k string, f long, l long, s double")
    assert {(r["k"], r["f"], r["l"]) for r in joins.last_write(rows, "k", ["f", "l"]).collect()} == {("a", 2, 1), (None, 5, 5), ("b", 7, 7)}
    assert {(r["k"], r["f"], r["l"]) for r in joins.first_write(rows, "k", ["f", "l"]).collect()} == {("a", None, 3), (None, 4, 9), ("b", 7, 7)}
    assert {(r["k"], r["f"]) for r in split.best(rows, ["k"], "s", "f").collect()} == {("a", 2), (None, 4), ("b", 7)}
    plan = joins.last_write(rows, "k", ["f", "l"])._jdf.queryExecution().toString()
    assert "Window" not in plan and "partial_max_by" in plan
