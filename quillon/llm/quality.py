"""Quality rules with an isolation forest over rule statistics.

One pass over the texts gives every document its rule statistics, written once as a narrow
table. A forest of random splits is grown on a bounded sample of labelled good rows
(``fit_rows``, chosen by a hash of the id); its splits are drawn from the box of the whole
sample, so that what no good row shows is cut off early. A document's score is 2 ** -(mean path
length / the mean of a random tree): near 1 for odd ones. The rejection threshold comes from all
labelled rows: the scores of good and bad rows are counted in ``bins`` bins and the threshold is
the one that separates them best while it rejects at most ``max_good_loss`` of the good ones.

Defined cases: a null text has no words and fails the base rules; several labels of one id count
as bad if one is; null labels are ignored; without labelled good rows, or without bad ones, the
forest rejects nothing; rows are judged one by one, so repeated rows share a verdict; an empty
table gives an empty result; columns other than doc_id and text are carried by ``keep_good`` only.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_batches, hash_sample, materialize, texts

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
CONTINUATION = bytes(range(128, 192))

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPE = ("n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_exclaim", "n_points", "n_long")
STATS = (*BASE, *SHAPE)
#: Words of this many bytes count as long.
LONG_WORD = 24


def repeat_words(words: list[bytes]) -> int:
    """Words lying in a three-word window that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, inside = Counter(windows), bytearray(len(words))
    for k, w in enumerate(windows):
        if seen[w] > 1:
            inside[k : k + 3] = b"\1\1\1"
    return inside.count(1)


def dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; lines with a word."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines)), len(lines)


def statistics(text: bytes) -> tuple[int, ...]:
    words = text.split()
    gone = lambda chars: len(text) - len(text.translate(None, chars))
    repeated, lines = dup_lines(text)
    return (
        len(words), sum(map(len, words)) - gone(CONTINUATION), gone(SYMBOLS), repeated, repeat_words(words),
        lines, len(set(words)), gone(UPPER), gone(LOWER), gone(DIGITS), text.count(b"!"), gone(b".,;:?"),
        sum(len(w) >= LONG_WORD for w in words),
    )


def rule_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and one long per statistic of ``text``."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([statistics(t) for t in texts(batch)], np.int64).reshape(-1, len(STATS))
            arrays = [batch.column(c) for c in keep] + [pa.array(found[:, k]) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *STATS])

    slim = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = slim.select(*keep, *[F.lit(None).cast("long").alias(s) for s in STATS]).schema
    for field in schema:
        field.nullable = True
    return slim.mapInArrow(run, schema)


# -- the forest ----------------------------------------------------------------------------


def features(x: np.ndarray) -> np.ndarray:
    """Rates out of a matrix of statistics; rates of rare things on a root scale, sizes on a log scale."""
    v = dict(zip(STATS, x.T.astype(np.float64)))
    words, lines = np.maximum(v["n_words"], 1), np.maximum(v["n_lines"], 1)
    letters = np.maximum(v["n_upper"] + v["n_lower"], 1)
    root = lambda y: np.sqrt(np.minimum(y, 4.0))
    return np.stack(
        [
            v["word_chars"] / words, root(v["n_symbols"] / words), root(v["n_dup_lines"] / lines), root(v["n_repeat_words"] / words),
            root(v["n_upper"] / letters), root(v["n_digits"] / words), root(v["n_exclaim"] / words), root(v["n_points"] / words),
            np.log1p(words / lines), v["n_distinct"] / words, root(v["n_long"] / words),
        ],
        axis=1,
    )


def mean_path(n: float) -> float:
    """Average depth of an unsuccessful search among n rows of a random tree."""
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


class Forest:
    """Arrays of all trees, one row a tree: split feature (-1: leaf), split value, left child, path length."""

    def __init__(self, good: np.ndarray, box: np.ndarray, trees: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        rows = min(rows, len(good))
        self.depth, self.norm = int(np.ceil(np.log2(max(rows, 2)))) + 2, max(mean_path(rows), 1e-9)
        size = 2 ** (self.depth + 1)
        self.feature = np.full((trees, size), -1, np.int16)
        self.value = np.zeros((trees, size))
        self.path = np.zeros((trees, size))
        low, high = box.min(axis=0), box.max(axis=0)
        for t in range(trees):
            self._grow(t, 1, good[rng.choice(len(good), rows, replace=False)], low.copy(), high.copy(), 0, rng)

    def _grow(self, t, node, x, low, high, depth, rng):
        self.path[t, node] = depth + mean_path(len(x))
        open_ = np.nonzero(high > low)[0]
        if len(x) <= 1 or depth >= self.depth or not len(open_):
            return
        f = int(rng.choice(open_))
        at = rng.uniform(low[f], high[f])
        self.feature[t, node], self.value[t, node] = f, at
        left = x[:, f] < at
        low_, high_ = low.copy(), high.copy()
        low_[f] = high_[f] = at
        self._grow(t, 2 * node, x[left], low, high_, depth + 1, rng)
        self._grow(t, 2 * node + 1, x[~left], low_, high, depth + 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.value[t, node]
                node = np.where(inner, 2 * node + right, node)
            total += self.path[t, node]
        return 2.0 ** -(total / len(self.feature) / self.norm)


def choose_threshold(good: np.ndarray, bad: np.ndarray, max_good_loss: float) -> float:
    """The lower edge of the first rejected bin; 1.1 rejects nothing."""
    bins = len(good)
    if not good.sum() or not bad.sum():
        return 1.1
    above = lambda h: np.cumsum(h[::-1])[::-1] / h.sum()  # noqa: E731  share at or above each bin
    lost, caught = above(good), above(bad)
    gain = np.where(lost <= max_good_loss, caught - lost, -1.0)
    k = int(np.argmax(gain))
    return k / bins if gain[k] > 0 else 1.1


def judge(
    stats: DataFrame, labels: DataFrame, trees: int = 100, rows: int = 256, fit_rows: int = 8192, bins: int = 1000,
    max_good_loss: float = 0.005, seed: int = 7,
) -> DataFrame:
    """A stored table of statistics with base_failed, anomaly and kept.

    ``fit_rows``: bound of the labelled sample that forest and box are taken from.
    """
    spark = stats.sparkSession
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", base_failed)
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stats.where("not base_failed").join(marks, "doc_id").select("doc_id", "quality", *STATS)
    labelled = materialize(labelled, "quality-labelled")
    sample = hash_sample(labelled, fit_rows, "doc_id", *STATS).toPandas()
    good = sample[sample.quality == 1]
    forest = None
    if len(good):
        forest = Forest(features(good[list(STATS)].to_numpy()), features(sample[list(STATS)].to_numpy()), trees, rows, seed)

    def scored(frame: DataFrame, *keep: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                x = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS], axis=1)
                s = forest.score(features(x)) if forest else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s)], names=[*keep, "anomaly"])

        schema = frame.select(*keep).withColumn("anomaly", F.lit(0.0)).schema
        for field in schema:
            field.nullable = True
        return frame.select(*dict.fromkeys([*keep, *STATS])).mapInArrow(run, schema)

    bin_ = F.least(F.floor(F.col("anomaly") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    hist = scored(labelled, "quality").groupBy("quality", bin_).count().collect()  # at most 2 * bins rows
    counts = np.zeros((2, bins))
    for r in hist:
        counts[int(r["quality"] == 1), r["bin"]] += r["count"]
    threshold = choose_threshold(counts[1], counts[0], max_good_loss)
    judged = scored(stats, *stats.columns)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * bins) < round(threshold * bins)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were."""
    packed = docs.select(F.struct("*").alias("doc"), "doc_id", "text")
    stats = materialize(rule_statistics(packed, keep=("doc", "doc_id")), "quality-rows")
    return judge(stats, labels).where("kept").select("doc.*")
