"""Runs of words by their hashes, and rows put in order to be compared with their neighbours."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize, shuffle_parts

#: Stands for a null doc_id, so that it sorts first.
NULL_ID = -(1 << 63)
#: Odd multipliers of the two lanes of a hash, and their inverses modulo 2 ** 64.
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
BACK = tuple(np.uint64(pow(int(x), -1, 1 << 64)) for x in ODD)
ORDER = ["run", "h", "id", "key", "begin"]


# -- words and their hashes ----------------------------------------------------------------


def word_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits a word, as two lanes."""
    data = b"".join(map(xxhash.xxh3_128_digest, words))
    return np.frombuffer(data, "<u8").reshape(-1, 2).T


@lru_cache(maxsize=8)
def _powers(n: int):
    """Powers of ODD and BACK up to the n-th, a lane a row."""
    ones = np.ones((2, 1), np.uint64)
    up, down = (np.repeat(np.array(x, np.uint64)[:, None], n, axis=1) for x in (ODD, BACK))
    return tuple(np.cumprod(np.concatenate([ones, x], axis=1), axis=1, dtype=np.uint64) for x in (up, down))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a text by their hashes, with the hash of any run of them from sums over the text."""

    def __init__(self, words: list[bytes]):
        self.lanes = lanes = word_hashes(words)
        self.n = lanes.shape[1]
        self.up, self.down = _powers(1 << max(12, self.n.bit_length()))
        self.sums = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(lanes * self.up[:, : self.n], axis=1, dtype=np.uint64)], axis=1)

    def run(self, begin: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
        sums = self.sums[lane]
        return _scramble((sums[end] - sums[begin]) * self.down[lane][begin])


# -- documents and order -------------------------------------------------------------------


def named(docs: DataFrame) -> DataFrame:
    """id, key and text of the rows of ``docs`` that have a text; id and key together tell documents apart."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")
    return docs.where("text is not null").select(id_, text_key().alias("key"), "text")


def text_key() -> Column:
    return F.xxhash64("doc_id", "text")


def neighbours(rows: DataFrame, name: str, tests: bool) -> tuple[DataFrame, DataFrame | None]:
    """``rows(run, h, id, key, begin, end, at)`` put in order; what repeats, and (id, key, at) of block heads in runs of several.

    A block: equal run and h. Its first row stands at the least place; every other one is returned as
    (id, key, begin, end, first_id, first_begin).
    """
    spark = rows.sparkSession
    small = {"kind", "part", "begin", "end", "at", "first_begin"}
    names = ["kind", "part", "id", "key", "begin", "end", "at", "first_id", "first_key", "first_begin", "run", "h", "last_run", "last_h"]
    schema = ", ".join(f"{c} {'int' if c in small else 'long'}" for c in names)

    def compare(batches):
        part, head, last, first, last_place = TaskContext.get().partitionId(), None, None, None, None

        def emit(kind, n, **columns):
            columns |= {"kind": np.full(n, kind), "part": np.full(n, part)}
            types = [pa.int32() if c in small else pa.int64() for c in names]
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            run, h, id_, key, begin, end, at = (batch.column(c).to_numpy() for c in (*ORDER, "end", "at"))
            words, place = np.stack([run, h]), np.stack([id_, key, begin.astype(np.int64)])
            head = words[:, 0] if head is None else head
            before = np.concatenate([(words[:, 0] ^ 1 if last is None else last)[:, None], words[:, :-1]], axis=1)
            # the place of the first row of each row's block: in this batch, or carried on from the one before
            new = (words != before).any(axis=0)
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            firsts = place[:, np.maximum(start, 0)]
            if first is not None:
                firsts[:, start < 0] = first[:, None]
            earlier = np.concatenate([(place[:, 0] ^ 1 if last_place is None else last_place)[:, None], place[:, :-1]], axis=1)
            again = ~new & (place == earlier).all(axis=0)  # a repeated row
            in_head = (words == head[:, None]).all(axis=0)
            found = ~again & ((firsts != place).any(axis=0) | in_head)
            for kind, k in ((0, np.nonzero(found & ~in_head)[0]), (1, np.nonzero(found & in_head)[0])):
                if len(k):
                    yield emit(kind, len(k), id=id_[k], key=key[k], begin=begin[k], end=end[k], first_id=firsts[0, k], first_key=firsts[1, k], first_begin=firsts[2, k])
            if tests:
                # heads of blocks next to another block of their run; where a batch begins or ends, all
                same = run[1:] == run[:-1]
                changes = np.nonzero(new)[0]
                after = np.append(changes[1:], len(run))
                beside = (changes == 0) | (after == len(run))
                inner = ~beside
                beside[inner] = same[changes[inner] - 1] | same[after[inner] - 1]
                k = changes[beside]
                if len(k):
                    yield emit(2, len(k), id=id_[k], key=key[k], at=at[k])
            last, first, last_place = words[:, -1], firsts[:, -1], place[:, -1]
        if head is not None:
            yield emit(3, 1, id=first[:1], key=first[1:2], begin=first[2:], run=head[:1], h=head[1:], last_run=last[:1], last_h=last[1:])

    stored = materialize(rows.select(*ORDER, "end", "at"), f"{name}-rows")
    # repeated rows are told apart too, so that a range ends among them
    keys = [*ORDER, F.monotonically_increasing_id()]
    ranged = stored.repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*ORDER)
    found = materialize(ranged.mapInArrow(compare, schema), f"{name}-neighbours")
    discard(stored)
    # the place of the first row of a block that a partition begins with, if it began before; one row a partition
    carried, block, place = {}, None, None
    for r in sorted(found.where("kind = 3").collect(), key=lambda r: r["part"]):
        if (r["run"], r["h"]) == block:
            carried[r["part"]] = place
        if (r["last_run"], r["last_h"]) != block:
            block, place = (r["last_run"], r["last_h"]), (r["id"], r["key"], r["begin"])

    def settle(batches):
        parts = np.array(sorted(carried), np.int64)
        places = np.array([carried[p] for p in parts.tolist()], np.int64).reshape(-1, 3)
        for batch in batches:
            kind, part, id_, key, begin, *first = (batch.column(c).to_numpy() for c in ("kind", "part", "id", "key", "begin", "first_id", "first_key", "first_begin"))
            first = np.stack(first, axis=1).astype(np.int64)
            at = np.minimum(np.searchsorted(parts, part), max(len(parts) - 1, 0))
            goes_on = (kind == 1) & (parts[at] == part) if len(parts) else np.zeros(len(part), bool)
            first[goes_on] = places[at[goes_on]]
            k = np.nonzero((first != np.stack([id_, key, begin], axis=1)).any(axis=1))[0]
            kept = batch.select(out[:4]).take(pa.array(k))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(first[k, 0]), pa.array(first[k, 2].astype(np.int32))], names=out)

    out = ["id", "key", "begin", "end", "first_id", "first_begin"]
    again = found.where("kind <= 1").select("kind", "part", *out, "first_key").mapInArrow(settle, "id long, key long, begin int, end int, first_id long, first_begin int")
    return again, found.where("kind = 2").select("id", "key", "at") if tests else None
