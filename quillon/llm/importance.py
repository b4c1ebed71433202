"""Resampling towards a target distribution: hashed n-gram importance weights, exact draw without replacement.

Every run of 1 to ``ngrams`` words falls into one of ``buckets``; raw and target counts of the buckets
give each bucket a gain, floor(1000 * log ratio) with one added to every bucket. A text's weight is the
sum of its features' gains: an array of gains, indexed by the array of its buckets. Seeded Gumbel noise is added,
and the highest scores are drawn, which samples in proportion to the weights without replacement.

The draw never orders all rows. Keys (score, doc_id, row) are unique, and the k-th of them is found by
distributed radix selection: counts of 16-bit digits, from the highest that differs, tell the digit of
the k-th key, and the next digit is counted among the rows that share it. A round is one pass over a narrow
stored table and returns at most 65,536 counts. Only the drawn rows are then sorted, by range partitions,
and ranked by their place and the rows of the partitions before.

Texts are read twice, for counts and for weights, and never shuffled. The gains are broadcast: ``buckets``
numbers whatever the input. Counts leave a task once, as one row a bucket.

Defined cases: a null or empty text has no features and weight 0; ties go to the smaller doc_id, a null one
last, then to the row stored first; repeated rows count and are drawn as often as they occur; without target
or raw texts the gains still are those of the formula; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_batches, materialize, shuffle_parts, texts
from quillon.llm.terms import terms

DIGIT = 16
#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
PART_BITS = 33
#: Features a task remembers the buckets of, and the bytes of the longest of them.
KNOWN, KNOWN_BYTES = 1 << 18, 64


class Buckets(dict):
    """Bucket of a feature; remembers the short ones, forgets all when there are too many."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.n
        if len(feature) <= KNOWN_BYTES:
            if len(self) >= KNOWN:
                self.clear()
            self[feature] = bucket
        return bucket


def features(text: bytes, ngrams: int) -> list[bytes]:
    words = terms(text)
    found = list(words)
    for n in range(2, ngrams + 1):
        found += map(b" ".join, zip(*(words[k:] for k in range(n))))
    return found


def _buckets_of(text: bytes, ngrams: int, known: Buckets) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, features(text, ngrams)), np.int64)


def bucket_counts(docs: DataFrame, ngrams: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in texts(batch):
                total += np.bincount(_buckets_of(text, ngrams, known), minlength=buckets)
        here = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(total[here])], names=["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: float = 1000.0) -> np.ndarray:
    """floor(scale * log ratio of the target's to the raw share of each bucket), one added to every count."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int, scale: float = 1000.0) -> int:
    """Gumbel noise of a row, from the first 32 bits of a hash of its id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, ngrams: int, seed: int) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_words, n_features, weight, score."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = shared.value
        known = Buckets(len(gain))
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, texts(batch)):
                found = _buckets_of(text, ngrams, known)
                # runs of 1 to ngrams words: words = the number of features if n = 1
                n_words = len(found) if ngrams == 1 else len(terms(text))
                weight = int(gain[found].sum())
                rows.append((doc, n_words, len(found), weight, weight + noise(doc, seed)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "n_words", "n_features", "weight", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _biased(x: int) -> int:
    return x + (1 << 63)


def _digit(col: Column, shift: int) -> Column:
    """Digit of a long in unsigned order."""
    return F.shiftrightunsigned(col.bitwiseXOR(F.lit(-(1 << 63))), shift).bitwiseAND((1 << DIGIT) - 1)


def kth_key(df: DataFrame, keys: list[Column], k: int) -> list[int]:
    """The k-th least (from 1) of the keys, longs without nulls, by radix selection over ``df``; ``df`` has k rows at least."""
    found: list[int] = []
    for key in keys:
        tied = df
        for column, value in zip(keys, found):
            tied = tied.where(column == value)
        low, high = (_biased(x) for x in tied.agg(F.min(key), F.max(key)).first())
        differ = (low ^ high).bit_length()
        value, at = low >> differ << differ, differ  # the digits above are common to all
        while at > 0:
            shift = max(at - DIGIT, 0)
            here = tied.where((_prefix(key, at)) == _prefix(F.lit(value - (1 << 63)), at)) if at < differ else tied
            counts = here.groupBy(_digit(key, shift).alias("d")).count().collect()  # at most one row a digit
            for d, n in sorted((r["d"], r["count"]) for r in counts):
                if k <= n:
                    mask = (1 << (at - shift)) - 1
                    value |= (d & mask) << shift
                    break
                k -= n
            at = shift
        found.append(value - (1 << 63))
    return found


def _prefix(col: Column, at: int) -> Column:
    """All bits of a long from ``at`` up."""
    return F.shiftrightunsigned(col.bitwiseXOR(F.lit(-(1 << 63))), at) if at < 64 else F.lit(0).cast("long")


def top(scored: DataFrame, k: int) -> DataFrame:
    """Add ``rank`` to a stored table (doc_id, score, row, ...): 1 to k for the k highest scores, null for the others.

    ``row``: a long that tells rows apart. Ties go to the smaller doc_id, a null one last, then to the lesser row.
    """
    k = min(k, scored.count())
    unranked = F.lit(None).cast("long").alias("rank")
    if k < 1:
        return scored.select("*", unranked)
    # the complement of a score, not its negative, which the least long hasn't
    keys = [F.bitwise_not("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)).cast("long"), F.col("row")]
    cut = kth_key(scored, keys, k)
    drawn = F.lit(True)
    for key, value in reversed(list(zip(keys, cut))):
        drawn = (key < value) | ((key == value) & drawn)
    order = [key.alias(f"_k{i}") for i, key in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    spark = scored.sparkSession
    ranged = scored.where(drawn).select("*", *order).repartitionByRange(shuffle_parts(spark), *names).sortWithinPartitions(*names).drop(*names)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "importance-drawn")
    part, offsets, before = F.shiftright("_at", PART_BITS), [], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << PART_BITS) - 1) + 1
    ranked = placed.withColumn("_part", part).join(starts, "_part").select(*scored.columns, rank.alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select("*", unranked))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), min_words: int = 20, ngrams: int = 1, buckets: int = 10000, seed: int = 2024
) -> DataFrame:
    """``docs(doc_id, text)`` towards the texts of ``target(text)``: every row with n_features, weight, score and rank.

    ``share``: numerator and denominator of the part of the rows with ``min_words`` words that is drawn; the
    other rows and those not drawn have a null rank.
    """
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    weighed = weigh(docs, gain, ngrams, seed).withColumn("row", F.monotonically_increasing_id())
    stored = materialize(weighed, "importance-scores")
    able = F.col("n_words") >= min_words
    n = stored.where(able).count()
    ranked = top(stored.where(able), share[0] * n // share[1])
    rest = stored.where(~able).select("*", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest).drop("row")
