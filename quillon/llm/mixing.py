"""Mixing sources to target weights by hierarchical budgets.

The tree is domain - language - source. A total of tokens is dealt down it by weight. A node takes at
most its capacity, the tokens below it times ``max_epochs``; what it can't take goes to its siblings by
weight, and only what no sibling can take is left to the level above, because a parent's own capacity is
the sum of its children's. Budgets are whole tokens, rounded down at each level.

A leaf's budget is spent on epochs, each a permutation of its rows by a seeded hash of epoch and doc_id:
whole epochs first, then the prefix of the next whose token count is nearest the rest. The prefix is found
without ordering a leaf: token sums of 4,096 slices of the hash range show the slice where the cut lies, those of
4,096 slices of that slice show it closer, and only the last is ordered: a leaf's 16 millionth part. Slices are
summed by sixty-fours first, so that a leaf's sums are never many in one task. Everything is DataFrame operations; the plan, one row a leaf, is broadcast when it
has at most ``broadcast_leaves`` rows and otherwise joined.

Defined cases: a null text has no tokens; null languages and sources form a leaf of their own, named ''; nodes
of weight 0 get nothing; rows of equal doc_id and token count in a leaf share their fate; rows without tokens
count as tokens nowhere and follow their place in the permutation; an empty table gives an empty result; other
columns are returned as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize

LEVELS = ("domain", "lang", "source")
#: Hex digits of a hash that tell its slice, at each of two levels; a slice's group is told by all but GROUP values of them.
SLICE_DIGITS = 3
GROUP = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(nodes: DataFrame, parents: list[str], node: str) -> DataFrame:
    """Add ``budget`` to nodes(parents..., node, weight, capacity, given): ``given`` dealt among siblings."""
    ratio = F.col("capacity") / F.col("weight")
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = siblings.orderBy("ratio", node).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    weights = F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.col("given") - spent).cast("double") / weights
    share = F.floor(F.col("level") * F.col("weight") + 1e-6).cast("long")
    return (
        nodes.where("weight > 0").withColumn("ratio", ratio).withColumn("here", level)
        .withColumn("level", F.max("here").over(siblings))
        .withColumn("budget", F.greatest(F.lit(0), F.least("capacity", share))).drop("ratio", "here", "level", "given")
    )


def budgets(leaves: DataFrame, weights: dict[str, Column], total_share: float, max_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens) with the budget of each."""
    given = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(total_share))).cast("long").alias("given"))
    above, keys = None, []
    for depth, level in enumerate(LEVELS):
        names = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("capacity", F.col("tokens") * max_epochs).withColumn("weight", weights[level].cast("long"))
        nodes = nodes.join(above, keys) if keys else nodes.withColumn("given", F.lit(given.first()["given"]))
        filled = fill(nodes, keys, level)
        above, keys = filled.select(*names, F.col("budget").alias("given")), names
    return filled.select(*LEVELS, "tokens", "budget")


def edges(rows: DataFrame, hint) -> DataFrame:
    """rows(LEVELS, rest, slice, n_tokens) to the slice of each leaf in which its tokens exceed ``rest``, and the tokens ``before`` it."""
    sums = materialize(rows.groupBy(*LEVELS, "rest", "slice").agg(F.sum("n_tokens").alias("n")), "mix-slices")
    upto = lambda by: Window.partitionBy(*LEVELS).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    group = F.floor(F.col("slice") / GROUP).cast("int")

    def first(parts: DataFrame, by: str, before) -> DataFrame:
        over = parts.withColumn("after", before + F.sum("n").over(upto(by))).where("after > rest")
        found = over.groupBy(*LEVELS).agg(F.min_by(F.struct(by, (F.col("after") - F.col("n")).alias("before")), by).alias("e"))
        return found.select(*LEVELS, F.col(f"e.{by}").alias("edge"), "e.before")

    coarse = sums.groupBy(*LEVELS, "rest", group.alias("group")).agg(F.sum("n").alias("n"))
    near = sums.join(hint(first(coarse, "group", F.lit(0))), list(LEVELS)).where(group == F.col("edge")).drop("edge")
    return materialize(first(near, "slice", F.col("before")), "mix-edges")


def mix(
    docs: DataFrame, domain: Column, weights: dict[str, Column], tokens: Column | None = None, total_share: float = 1.0,
    max_epochs: int = 2, seed: int = 17, broadcast_leaves: int = 20_000,
) -> DataFrame:
    """``doc`` (a struct of the columns of ``docs``), domain, lang, source, n_tokens and copies of every row.

    ``domain``: the domain of a row. ``weights``: for each of domain, lang and source a whole number, an
    expression over the columns of that name. ``tokens``: the size of a row; words by default.
    """
    tokens = word_count(F.col("text")) if tokens is None else tokens
    leaf = [F.coalesce(domain.cast("string"), F.lit("")).alias("domain")] + [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS[1:]]
    slim = docs.select(F.col("doc_id").cast("string").alias("id"), *leaf, tokens.alias("n_tokens"))
    slim = materialize(slim, "mix-rows")
    leaves = materialize(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    plan = budgets(leaves, weights, total_share, max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("int"))
    plan = materialize(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "mix-plan")
    small = plan.count() <= broadcast_leaves
    hint = F.broadcast if small else (lambda df: df)

    def place(epoch: Column, id_: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_, F.lit(""))).cast("binary"))

    def slice_of(key: Column, level: int) -> Column:
        return F.conv(F.substring(key, 1 + (level - 1) * SLICE_DIGITS, SLICE_DIGITS), 16, 10).cast("int")

    placed = slim.join(hint(plan.select(*LEVELS, "epochs", "rest")), list(LEVELS)).withColumn("key", place(F.col("epochs"), F.col("id")))
    outer = edges(placed.withColumn("slice", slice_of(F.col("key"), 1)), hint)
    inside = placed.join(hint(outer), list(LEVELS)).where(slice_of(F.col("key"), 1) == F.col("edge"))
    inside = inside.select(*LEVELS, (F.col("rest") - F.col("before")).alias("rest"), "key", "n_tokens", slice_of(F.col("key"), 2).alias("slice"))
    inside = materialize(inside, "mix-inside")
    inner = edges(inside, hint)
    inside = inside.join(hint(inner), list(LEVELS)).where("slice = edge")
    inside = inside.groupBy(*LEVELS, "rest", "before", "key", "n_tokens").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy(*LEVELS).orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("before") + F.sum(F.col("n_tokens") * F.col("rows")).over(upto)
    taken = inside.withColumn("after", after).where(2 * F.col("after") - F.col("n_tokens") * F.col("rows") <= 2 * F.col("rest"))
    cut = taken.groupBy(*LEVELS).agg(F.max(F.struct("key", "n_tokens")).alias("cut"))
    slices = 16**SLICE_DIGITS
    edge = outer.select(*LEVELS, F.col("edge").alias("outer")).join(inner.select(*LEVELS, F.col("edge").alias("inner")), list(LEVELS))
    edge = edge.select(*LEVELS, (F.col("outer") * slices + F.col("inner")).alias("edge"))
    final = plan.select(*LEVELS, "epochs").join(edge, list(LEVELS), "left").join(cut, list(LEVELS), "left")
    final = materialize(final, "mix-cuts")

    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("string").alias("id"), *leaf, tokens.alias("n_tokens"))
    out = whole.join(hint(final), list(LEVELS), "left").withColumn("key", place(F.col("epochs"), F.col("id")))
    here = slice_of(F.col("key"), 1) * slices + slice_of(F.col("key"), 2)
    in_cut = F.col("cut").isNotNull() & (F.struct("key", "n_tokens") <= F.col("cut"))
    more = F.col("epochs").isNotNull() & (F.col("edge").isNull() | (here < F.col("edge")) | ((here == F.col("edge")) & in_cut))
    copies = F.coalesce(F.col("epochs"), F.lit(0)) + more.cast("int")
    return out.select("doc", *LEVELS, "n_tokens", copies.alias("copies"))


def mixed_rows(docs: DataFrame, domain: Column, weights: dict[str, Column], **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it."""
    rows = mix(docs, domain, weights, **options).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
