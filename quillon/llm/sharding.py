"""Consistent hashing with bounded loads: documents onto shards, balanced exactly.

Every shard owns ``virtual`` points of a ring. A row's key hashes to a position and belongs to
the first point clockwise; when that shard is full the row goes on clockwise to the next shard
with room. Capacities are the floor or ceiling of rows / shards times (1 + ``slack``), so with
``slack`` 0 the row counts of two shards differ by one at most.

Rows arrive in ring order, arc by arc. The walk therefore depends only on how many rows lie in each arc
between two points: ``shards * virtual`` numbers, a parameter and not the size of the data, are
all the driver sees. It turns them into runs "ranks lo..hi of this arc go to that shard", which
are broadcast (at most 2 * points + shards runs). Ranks come from one order of all rows by range
partitions: the place in a partition, plus the rows of the partitions before (one number a
partition), less the rows of the arcs before. Rows of one key are told apart in that order, so no
key, however frequent, is one task's work.

Defined cases: a null text has size 1 and the checksum of no bytes; a null key hashes as the empty
string; rows with equal keys are told apart by size and checksum and otherwise interchangeable; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, shuffle_parts

RING_BITS = 32
#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
PART_BITS = 33


def ring(shards: int, virtual: int, seed: int) -> list[tuple[int, int]]:
    """Sorted (position, shard) points; a shard's points do not depend on the number of shards."""
    points = {}
    for shard in range(shards):
        for v in range(virtual):
            digest = hashlib.md5(f"{seed}:{shard}:{v}".encode()).hexdigest()
            points.setdefault(int(digest[: RING_BITS // 4], 16), shard)
    return sorted(points.items())


def capacities(total: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [-(-int(total * (1 + slack) + 0.5) // shards) + 1] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(points: list[tuple[int, int]], counts: dict[int, int], room: list[int]):
    """Runs (arc, lo, hi, shard, slot of lo) of one clockwise pass over the arcs."""
    room, filled, runs, n = list(room), [0] * len(room), [], len(points)
    for arc in range(n):
        rank, left, at = 0, counts.get(arc, 0), arc
        while left:
            shard = points[at % n][1]
            take = min(left, room[shard])
            if take:
                runs.append((arc, rank, rank + take, shard, filled[shard]))
                room[shard] -= take
                filled[shard] += take
                rank, left = rank + take, left - take
            at += 1
    return runs


def shard(
    docs: DataFrame, shards: int = 16, virtual: int = 128, slack: float = 0.0, seed: int = 11
) -> DataFrame:
    """``docs(doc_id, text)`` with size, text_crc32, home (the shard before overflow), shard and slot."""
    spark = docs.sparkSession
    points = ring(shards, virtual, seed)
    bounds = [p for p, _ in points]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    position = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, RING_BITS // 4), 16, 10).cast("long")
    # the arc of a position: index of the first point at or after it, wrapping to 0
    folded = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<long>")  # noqa: E731  a constant to Catalyst
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        position.alias("position"),
    )
    cells = 1 << 12
    first = [bisect_left(bounds, c << (RING_BITS - 12)) for c in range(cells + 1)]
    cell = F.shiftright(F.col("position"), RING_BITS - 12).cast("int")
    lo, hi = F.element_at(folded(first), cell + 1), F.element_at(folded(first), cell + 2)
    near = F.slice(folded(bounds), (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    inside = F.size(F.filter(near, lambda b: b < F.col("position")))
    arcs = slim.withColumn("arc", ((lo + inside) % len(points)).cast("int")).select("doc_id", "size", "text_crc32", "arc", "position")
    arcs = materialize(arcs, "shard-arcs")
    counts = {r["arc"]: r["count"] for r in arcs.groupBy("arc").count().collect()}  # one number a point
    runs: dict[int, list] = {}
    for arc, a, b, s, slot in walk(points, counts, capacities(sum(counts.values()), shards, slack)):
        runs.setdefault(arc, []).append((a, b, s, slot))
    plan, before = [], 0
    for arc in sorted(counts):
        plan.append((arc, before, points[arc][1], runs[arc]))
        before += counts[arc]
    plan = spark.createDataFrame(plan, "arc int, before long, home int, runs array<struct<lo: long, hi: long, shard: int, slot: long>>")

    order = ["arc", "position", "doc_id", "size", "text_crc32"]
    ranged = arcs.repartitionByRange(shuffle_parts(spark), *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("at", PART_BITS)
    offsets, before = [], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    offsets = spark.createDataFrame(offsets, "part long, earlier long")
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").join(F.broadcast(plan), "arc")
    rank = F.col("earlier") + F.col("at").bitwiseAND((1 << PART_BITS) - 1) - F.col("before")
    ranked = ranked.withColumn("rank", rank).withColumn("run", F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0])
    return ranked.select(
        "doc_id", "size", "text_crc32", F.col("home"), F.col("run.shard").alias("shard"), (F.col("run.slot") + F.col("rank") - F.col("run.lo")).alias("slot"),
    )
