"""Exact top-k inner products of integer vectors by MaxScore.

A query's terms are its components. Within a block of candidates a term contributes between the
products of the query's component with the block's least and greatest value there; that spread is
the term's bound. Terms whose bounds together cannot lift a candidate to the current k-th score
are non-essential. The essential ones are traversed for all candidates; of the others, in
descending order of bound, a few at a time are probed for the candidates that still compete.
Ties are kept, so results are exact. Per-block results are merged by a rank within the query.

Queries are packed into blocks of ``query_rows``, candidates into blocks of ``block_rows``, inside
tasks, their components in as few bytes as hold them. Candidate blocks are dealt by hash into parts of about ``part_blocks``,
more and smaller ones where there would be fewer than shuffle partitions. Each candidate travels once, to its part; the query
blocks, as many as their number needs wherever the queries lay, are copied to every part. An equi-join on the part runs
through a part's candidates for one query block after the other, so a task holds one part and one query block. The k-th
score a query has reached in the part's blocks before is its floor in the next one, and a block whose bounds together lie
below it is left out for that query. Nothing is broadcast, and the driver sees only two counts.

Defined cases: a vector that is null or holds null, NaN or an infinity takes no part, nor does a row
with a null id; vectors of different lengths are compared as if the shorter ended in zeros; every row
but the query's own is its candidate, also one of the same id; a repeated query row is answered once
for each row; a score beyond 64 bits is the nearest long; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import arrow_batches, materialize, shuffle_parts

EXACT = 1 << 53
PROBE = 8


KINDS = ("<i1", "<i2", "<i4", "<i8")


def _pack(x: np.ndarray) -> tuple[int, bytes]:
    """Components in the least whole-number type that holds them all."""
    most = int(np.abs(x).max(initial=0))
    kind = next(k for k in range(4) if k == 3 or most < 1 << (8 << k) - 1)
    return kind, x.astype(KINDS[kind]).tobytes()


def _blocks(vectors: DataFrame, rows: int, scale: int) -> DataFrame:
    """``vectors(row, id, v)`` as rows of (block, dim, kind, rows, ids, vals): packed little-endian numbers."""

    def run(batches):
        number, held = TaskContext.get().partitionId() << 24, []

        def emit():
            nonlocal number
            part = held[:rows]
            del held[:rows]
            dim = max(len(v) for _, _, v in part)
            x = np.zeros((len(part), dim))
            for k, (_, _, v) in enumerate(part):
                x[k, : len(v)] = v
            kind, data = _pack(np.clip(np.floor(scale * x), -(2.0**62), 2.0**62).astype("<i8"))
            names, ids = (np.array([p[k] for p in part], "<i8").tobytes() for k in (0, 1))
            row = [[number], [dim], [kind], [names], [ids], [data]]
            number += 1
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=["block", "dim", "kind", "rows", "ids", "vals"])

        for batch in batches:
            held += zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), (np.asarray(v.values, np.float64) for v in batch.column("v")))
            while len(held) >= rows:
                yield emit()
        if held:
            yield emit()

    return vectors.mapInArrow(run, "block long, dim int, kind int, rows binary, ids binary, vals binary")


def top_of_block(q: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, k: int, floor):
    """Rows and scores of at least the k best candidates of a block with scores from ``floor`` up; counts of probes."""
    upper, lower = np.maximum(q * low, q * high), np.minimum(q * low, q * high)
    order = np.argsort(lower - upper, kind="stable")  # descending spread
    rest = np.concatenate([np.cumsum(upper[order][::-1])[::-1], [0]])  # bound of the terms from position t on
    if floor is None:
        seed = np.nonzero(~own)[0][: 8 * k]
        if len(seed) >= k:
            floor = np.sort(x[seed] @ q)[-k]
    # terms whose spreads together can't lift a candidate from the least score to the floor
    base = lower.sum()
    gains = np.cumsum((upper - lower)[order][::-1])[::-1]
    essential = len(q) if floor is None else int(np.count_nonzero(base + gains >= floor))
    terms = order[:essential]
    rows = np.nonzero(~own)[0]
    score = (x[:, terms] @ q[terms])[rows] if essential else np.zeros(len(rows), x.dtype)
    for t in range(essential, len(q) + PROBE, PROBE):
        if floor is not None:
            alive = score + rest[min(t, len(q))] >= floor
            rows, score = rows[alive], score[alive]
        if t >= len(q) or not len(rows):
            break
        terms = order[t : t + PROBE]
        score = score + x[np.ix_(rows, terms)] @ q[terms]
    return rows, score


def search(vectors: DataFrame, asks: str | Column, k: int, scale: int = 256, block_rows: int = 4096, query_rows: int = 8192, part_blocks: int = 64) -> DataFrame:
    """``vectors(id, v)``, of which the rows where ``asks`` holds are queries, to query_id, rank, vec_id, score: the k best, ties to the smaller id."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    real = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id is not null and v is not null").where(real)
    stored = materialize(usable.withColumn("row", F.monotonically_increasing_id()), "search-vectors")
    queries, packed = stored.where(asks), ("dim", "kind", "rows", "ids", "vals")
    asked = materialize(_blocks(queries.repartition(max(1, -(-queries.count() // query_rows))), query_rows, scale), "search-queries")
    parts = max(shuffle_parts(spark), -(-stored.count() // (block_rows * part_blocks)))
    held = _blocks(stored, block_rows, scale).select(F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), *packed)
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    mine = asked.select(F.col("block").alias("asked"), every, *[F.col(c).alias(f"q_{c}") for c in packed])
    pairs = mine.hint("merge").join(held, "part")

    def run(batches):
        block, floors = None, None
        for batch in batches:
            for r in (batch.slice(j, 1).to_pylist()[0] for j in range(batch.num_rows)):
                dim = max(r["dim"], r["q_dim"], 1)
                names, q_names, ids, q_ids = (np.frombuffer(r[c], "<i8") for c in ("rows", "q_rows", "ids", "q_ids"))
                pad = lambda p, n: np.pad(np.frombuffer(r[f"{p}vals"], KINDS[r[f"{p}kind"]]).reshape(n, r[f"{p}dim"]), ((0, 0), (0, dim - r[f"{p}dim"])))  # noqa: E731, B023
                x, qs = pad("", len(ids)), pad("q_", len(q_ids))
                big = [int(np.abs(m.astype(np.float64)).max(initial=0)) for m in (x, qs)]
                kind = np.float64 if big[0] * big[1] * dim < EXACT else object
                x, qs = x.astype(kind), qs.astype(kind)
                low, high = x.min(axis=0), x.max(axis=0)
                if r["asked"] != block:
                    block, floors = r["asked"], [None] * len(q_ids)
                out = []
                for row, (q_name, q_id, q) in enumerate(zip(q_names.tolist(), q_ids.tolist(), qs)):
                    rows, score = top_of_block(q, x, low, high, names == q_name, k, floors[row])
                    best = sorted(zip((-score).tolist(), ids[rows].tolist()))[:k] if len(rows) <= 4 * k else _best(score, ids[rows], k)
                    if len(best) == k:  # at least k candidates reach the last of these
                        floors[row] = -best[-1][0] if floors[row] is None else max(floors[row], -best[-1][0])
                    out += [(block, row, q_id, i, min(max(int(-s), -(1 << 63)), (1 << 63) - 1)) for s, i in best]
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["asked", "row", "query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "asked long, row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asked", "row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best(score, ids, k):
    order = np.lexsort((ids, (-score).astype(np.float64)))[: 4 * k] if score.dtype != object else range(len(ids))
    return sorted((-score[i], int(ids[i])) for i in order)[:k]
