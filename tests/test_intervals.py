"""Tokens under spans and pairs of spans against every pair; words and ids found in one pass against one search each."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import scan
from quillon.operators import intervals, ordered


def spans(rng, n, longest, groups=("a", "b", None)):
    out = []
    for k in range(n):
        b = rng.choice([None, *range(-50, 4000)]) if rng.random() < 0.05 else rng.randint(-50, 4000)
        e = None if rng.random() < 0.02 else (b or 0) + rng.choice([-2, 0, 1, 2, rng.randint(0, longest)])
        out.append((rng.choice(groups), b, e, k))
    return out


def overlap(x, y):
    return None not in (x[1], x[2], y[1], y[2]) and x[2] >= x[1] and y[2] >= y[1] and x[1] < y[2] and x[2] > y[1]


def test_labels_match_every_pair(spark):
    rng = random.Random(1)
    tokens, marks = spans(rng, 900, 12), spans(rng, 60, 300)
    schema = "g string, begin long, end long, id long"
    found = intervals.label_rows(spark.createDataFrame(tokens, schema).withColumn("x", F.lit("kept")), spark.createDataFrame(marks, schema), ["g"])
    want = {t[3]: t[3] if (t[1] is not None and t[2] is not None and t[2] > t[1] and any(m[0] == t[0] and overlap(t, m) for m in marks)) else -100 for t in tokens}
    assert {r["id"]: r["label"] for r in found.collect()} == want and found.columns == ["g", "begin", "end", "id", "x", "label"]


def test_a_million_tokens_under_one_span(spark):
    tokens = spark.range(1_000_000).select(F.lit("d").alias("g"), (F.col("id") * 3).alias("begin"), (F.col("id") * 3 + 2).alias("end"), "id")
    marks = spark.createDataFrame([("d", 0, 2_999_000), ("d", 2_999_500, 2_999_501)], "g string, begin long, end long")
    out = intervals.label_rows(tokens, marks, ["g"])
    assert out.where("label >= 0").count() == sum(k * 3 < 2_999_000 or (k * 3 < 2_999_501 and k * 3 + 2 > 2_999_500) for k in range(1_000_000))
    dealt = ordered.dealt(tokens, ["g"], ["end"], 8)
    assert dealt.groupBy(ordered.PART).count().agg(F.max("count")).first()[0] < 300_000


@pytest.mark.parametrize("longest", [5, 3000])
def test_pairs_match_every_pair(spark, longest):
    rng = random.Random(longest)
    a, b = spans(rng, 250, longest, ("a", "b")), spans(rng, 120, 40, ("a", "b"))
    schema = "g string, begin long, end long, id long"
    found = intervals.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["g"]).select("g", "l.id", F.col("r.id").alias("other")).collect()
    assert sorted((r["g"], r["id"], r["other"]) for r in found) == sorted((x[0], x[3], y[3]) for x in a for y in b if x[0] == y[0] and overlap(x, y))
    assert intervals.overlapping(spark.createDataFrame([], schema), spark.createDataFrame(b, schema), ["g"]).count() == 0


def test_running_sums_over_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), k, rng.choice([None, 1, 5])) for k in range(500)]
    out = ordered.dealt(spark.createDataFrame(rows, "g string, at long, v long"), ["g"], ["at"], 12)
    for how in ("sum", "max", "min"):
        out = ordered.running(out, F.col("v"), how, how)
    for g in "ab":
        held = []
        for r in sorted((r for r in out.collect() if r["g"] == g), key=lambda r: r["at"]):
            held += [r["v"]] if r["v"] is not None else []
            assert (r["sum"], r["max"], r["min"]) == ((sum(held), max(held), min(held)) if held else (None, None, None))


def one_by_one(text, nouns):
    """Mentions by a search for each noun."""
    ranges, out = [m for m in scan.RANGE.finditer(text)], []
    for noun in {n for n in nouns if n}:
        spots = [m.span() for m in re.finditer(re.escape(noun), text)]
        if ranges and spots and spots[0][0] >= ranges[0].end():
            for b, e in spots[: nouns.count(noun)]:
                last = [r for r in ranges if r.end() <= b][-1]
                out.append((noun, float(last[1]), float(last[2]), b, e))
    return sorted(out, key=lambda m: (m[3], m[4]))


def test_mentions_of_many_nouns_in_one_pass(spark):
    rng = random.Random(6)
    words = ["cup", "cups", "up", "red cup", "aa", "a", "(x)", "é", "dog", "", "do"] + [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(["<t>1.0s - 2.5s</t>", "<t>3s-4s</t>", "red cups", "aaa", "aaaa", "(x)", "w12", "w123", "dog é", "none"]) for _ in range(30)) for _ in range(40)] + ["", None]
    lists = [[rng.choice(words) for _ in range(rng.randint(0, 6))] + ["aa", "aa", "cup"] for _ in texts]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, lists)), "k int, t string, n array<string>").repartition(3)
    for r in df.withColumn("m", scan.noun_mentions_udf("t", "n")).collect():
        assert [tuple(m) for m in r["m"]] == one_by_one(r["t"] or "", r["n"])
    dictionary = [w for w in words if w]
    for r in scan.dictionary_mentions(df, "t", dictionary).collect():
        assert [tuple(m) for m in r["mentions"]] == one_by_one(r["t"] or "", dictionary)


def test_the_automaton_starts_anew_when_it_is_full(monkeypatch):
    monkeypatch.setattr(scan.Patterns, "MOST", 3)
    p = scan.Patterns(["a", "b"])
    p.add(["c", "d"])
    assert p.known == {"c", "d"} and p.spots("abcd") == {"c": [(2, 3)], "d": [(3, 4)]}


def test_patterns_of_ids():
    rng = random.Random(3)
    for _ in range(300):
        ids, pattern = [rng.randint(0, 2) << rng.choice([0, 8, 40]) for _ in range(rng.randint(0, 40))], [rng.randint(0, 2) for _ in range(rng.randint(0, 4))]
        assert scan.find_pattern(ids, pattern) == [k for k in range(len(ids) - len(pattern) + 1) if pattern and ids[k : k + len(pattern)] == pattern]
    assert scan.find_pattern([0] * 10, [0, 0]) == list(range(9)) and scan.find_pattern(None, [1]) == []
