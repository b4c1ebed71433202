"""Ranked lexical search by block-max bounds over an index with variable blocks.

``index`` turns runs of documents into shards inside the scan tasks. A shard holds, for each of its
terms, the documents it is in and what it contributes to each of them apart from the term's weight
(its impact), cut into blocks of variable length. Dynamic programming chooses the borders: it minimises the sum over
all postings of the block's greatest impact less their own, the error of the bound, plus a fixed price for
each block. Borders lie at every ``grain``-th posting, a block holds ``grain * longest`` at most; all terms of
a shard are solved side by side.

``search`` joins the terms of blocks of queries with the index. In a shard, the bounds of the blocks over a document (of a
rare term, only where the document is in its list), summed over the query's terms, bound its score; documents are taken in rounds by descending bound, in which only the blocks that cover one of
them are read, until the k-th score found exceeds what is left (a document with the same bound is still taken,
for ties). So results are exact. Shards are merged by rank.

The index is joined once for each block of ``query_rows`` queries; a task of the search holds the postings
of one shard for one block, bounded by ``shard_words``. Nothing is broadcast but what Spark finds small itself.
Texts are read twice: for the totals that impacts depend on, and for the index, which serves any number of searches.

Defined cases: a null or empty text holds no term and counts nowhere; nor does a query without terms; of a query, a
term counts once; repeated documents and queries are ranked and answered as often as they occur; a null doc_id ranks last
among equal scores, a null item_id is returned as it is; scores of 0 are left out; an empty table on either side gives an empty
result; other columns are ignored. One text is never cut, so a long one makes a shard alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import arrow_batches, materialize, texts
from quillon.llm.terms import terms

#: Term of the row that holds a shard's doc_ids; no text holds the empty term.
IDS = b""
#: A term in fewer than one document in so many of a shard is told by its documents, not by the spans of its blocks.
SPARSE = 8
#: Numbers of a table of the dynamic programme; rows of a batch of entries.
CELLS, ENTRIES = 1 << 21, 1 << 14
POSTINGS = "shard long, term binary, n long, docs binary, impacts binary, ends binary, peaks binary, ids array<long>"
ENTRY = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("docs", "impacts", "ends", "peaks")], ("ids", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class Index:
    """``postings``: a row for each term of each shard; ``n_docs``: texts with a term, ``n_terms``: their terms with repeats."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term contributes to a document of n terms, before its weight, in whole numbers."""
    m = 50 + (50 * n_docs * n) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _solve(values, starts, sizes, grain, longest, price):
    """Ends of the blocks of each list ``values[starts[i]:starts[i] + sizes[i]]``, longest list first, all advanced side by side."""
    grains = -(-sizes // grain)
    m, width = len(sizes), int(grains[0])
    at = np.concatenate([[0], np.cumsum(grains)])
    row, nth = np.repeat(np.arange(m), grains), np.arange(at[-1]) - np.repeat(at[:-1], grains)
    begin = starts[row] + grain * nth
    stop = np.minimum(begin + grain, (starts + sizes)[row])
    # a list's grains follow one another, lists don't: every second cut is where a grain stops
    cuts = np.stack([begin, stop], axis=1).ravel()
    peak = np.zeros((m, width))
    peak[row, nth] = np.maximum.reduceat(np.append(values, 0), cuts)[::2]
    sums = np.concatenate([[0], np.cumsum(values)])
    fixed = price * (sums[starts + sizes] - sums[starts]) / sizes
    # best[row, c]: the least cost of the grains up to c; back: grains of the last block
    best, back = np.zeros((m, width + 1)), np.zeros((m, width + 1), np.int16)
    running = np.zeros((m, longest))  # greatest of the last 1, 2, ... grains
    lengths = np.arange(1, longest + 1) * float(grain)
    live = np.searchsorted(-grains, -np.arange(1, width + 1), "right")  # lists that have a grain c
    for c in range(1, width + 1):
        a, w = int(live[c - 1]), min(c, longest)
        run = running[:a]
        run[:, 1:] = np.maximum(run[:, :-1], peak[:a, c - 1 : c])
        run[:, 0] = peak[:a, c - 1]
        cost = best[:a, c - w : c][:, ::-1] + run[:, :w] * lengths[:w]
        pick = cost.argmin(axis=1)
        best[:a, c] = cost[np.arange(a), pick] + fixed[:a]
        back[:a, c] = pick + 1
    out = []
    for r in range(m):
        ends, c = [], int(grains[r])
        while c > 0:
            ends.append(min(c * grain, int(sizes[r])))
            c -= int(back[r, c])
        out.append(ends[::-1])
    return out


def block_ends(values: np.ndarray, starts: np.ndarray, grain: int, longest: int, price: float) -> list[list[int]]:
    """Borders of each list ``values[starts[i]:starts[i + 1]]``: ends of its blocks, within the list, by dynamic programming.

    Over grains of ``grain`` values, the cost of a block is its values times their greatest, plus ``price`` times the
    list's mean; the values' own sum is the same for every choice.
    """
    sizes = np.diff(starts)
    out = [[n] for n in sizes.tolist()]  # what is one grain is one block
    order = np.argsort(-sizes, kind="stable")
    order, done = order[: np.count_nonzero(sizes > grain)], 0
    while done < len(order):
        width = -(-int(sizes[order[done]]) // grain)
        batch = order[done : done + max(1, CELLS // width)]
        for i, ends in zip(batch.tolist(), _solve(values, starts[batch], sizes[batch], grain, longest, price)):
            out[i] = ends
        done += len(batch)
    return out


def totals(docs: DataFrame) -> tuple[int, int]:
    """Texts with a term, and all terms with repeats."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        n = size = 0
        for batch in batches:
            for text in texts(batch):
                found = len(terms(text))
                n, size = n + (found > 0), size + found
        yield pa.RecordBatch.from_pydict({"n": [n], "size": [size]})

    r = docs.select("text").mapInArrow(run, "n long, size long").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    return r["n"] or 0, r["size"] or 0


def _binary(numbers: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Numbers cut at offsets, each part as little-endian bytes of 32-bit numbers."""
    data = numbers.astype("<u4").tobytes()
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype("<i4").tobytes()), pa.py_buffer(data)])


def _shard_rows(number, ids, sizes, tokens, words, n_docs, n_terms, grain, longest, price):
    """Batches of one shard: its documents by doc_id, the terms' postings by document."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    held = [np.unique(t, return_counts=True) for t in tokens]
    term, tf = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    owner = np.repeat(place, [len(h[0]) for h in held])
    by = np.lexsort((owner, term))
    term, tf, owner = term[by], tf[by], owner[by]
    value = impacts(tf, np.array(sizes, np.int64)[order][owner], n_docs, n_terms)
    starts = np.searchsorted(term, np.arange(len(words) + 1))
    ends = block_ends(value, starts, grain, longest, price)
    blocks = np.concatenate([[0], np.cumsum([len(e) for e in ends])])
    end = np.array([x for e in ends for x in e], np.int64)
    first = np.concatenate([[0], (end + np.repeat(starts[:-1], np.diff(blocks)))[:-1]])  # blocks lie end to end
    peak = np.maximum.reduceat(value, first)
    yield pa.RecordBatch.from_pydict({"shard": [number], "term": [IDS], "n": [0], "docs": [None], "impacts": [None], "ends": [None], "peaks": [None], "ids": [[ids[i] for i in order]]}, schema=ENTRY)
    for a in range(0, len(words), ENTRIES):
        b = min(a + ENTRIES, len(words))
        p, c = starts[a : b + 1], blocks[a : b + 1]
        columns = [_binary(owner[p[0] : p[-1]], p - p[0]), _binary(value[p[0] : p[-1]], p - p[0]), _binary(end[c[0] : c[-1]], c - c[0]), _binary(peak[c[0] : c[-1]], c - c[0])]
        rest = [pa.array(np.full(b - a, number)), pa.array(words[a:b], pa.binary()), pa.array(np.diff(p))]
        yield pa.RecordBatch.from_arrays([*rest, *columns, pa.nulls(b - a, pa.list_(pa.int64()))], schema=ENTRY)


def index(docs: DataFrame, shard_words: int = 1 << 22, grain: int = 8, longest: int = 16, price: float = 16.0) -> Index:
    """Index of ``docs(doc_id, text)``, stored; ``price`` of a block in postings of mean impact."""
    n_docs, n_terms = totals(docs)

    def run(batches):
        number, ids, sizes, tokens, known, held = TaskContext.get().partitionId() << 33, [], [], [], {}, 0

        def close():
            nonlocal number, held
            yield from _shard_rows(number, ids, sizes, tokens, list(known), n_docs, n_terms, grain, longest, price)
            number, held = number + 1, 0
            for x in (ids, sizes, tokens, known):
                x.clear()

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                found = terms(text)
                if not found:
                    continue
                if held and held + len(found) > shard_words:
                    yield from close()
                ids.append(doc)
                sizes.append(len(found))
                tokens.append(np.array([known.setdefault(w, len(known)) for w in found], np.int32))
                held += len(found)
        if ids:
            yield from close()

    arrow_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return Index(materialize(slim.mapInArrow(run, POSTINGS), "ranking-index"), n_docs, n_terms)


def _query_terms(items: DataFrame) -> DataFrame:
    """``items(item_id, text)`` to row, item_id and the distinct terms of each."""

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms(text))) for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["row", "item_id", "terms"])

    arrow_batches(items.sparkSession)
    slim = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), "text")
    return slim.mapInArrow(run, "row long, item_id long, terms array<binary>")


class Shard:
    """Postings of one shard for a block of queries, laid end to end, and its blocks."""

    def __init__(self, rows: pa.Table):
        found = {r["term"]: r for r in rows.to_pylist()}
        self.ids = found.pop(IDS)["ids"]
        take = lambda c, kind: [np.frombuffer(r[c], kind) for r in found.values()]
        docs, values, ends, peaks = take("docs", "<u4"), take("impacts", "<u4"), take("ends", "<u4"), take("peaks", "<u4")
        none = np.empty(0, np.int64)
        self.docs, self.values = (np.concatenate(x).astype(np.int64) if x else none for x in (docs, values))
        weights = np.array([r["weight"] for r in found.values()], np.int64)
        offsets = np.cumsum([0, *map(len, docs)])
        blocks = np.array([len(e) for e in ends], np.int64)
        self.first = np.cumsum([0, *blocks])  # blocks of a term
        self.end = np.concatenate([e + o for e, o in zip(ends, offsets)]).astype(np.int64) if ends else none
        self.begin = np.concatenate([np.concatenate([[0], e[:-1]]) + o for e, o in zip(ends, offsets)]).astype(np.int64) if ends else none
        self.weight = np.repeat(weights, blocks)
        self.peak = (np.concatenate(peaks).astype(np.int64) if peaks else none) * self.weight
        self.low, self.high = self.docs[self.begin], self.docs[self.end - 1]
        # where a term's bound holds: from first to last document of a block; a rare term's only at its documents
        sparse = np.repeat(np.diff(offsets) * SPARSE < len(self.ids), blocks)
        spread = np.where(sparse, self.end - self.begin, 1)
        owner = np.repeat(np.arange(len(spread)), spread)
        posting = (self.begin - (np.cumsum(spread) - spread))[owner] + np.arange(len(owner))
        self.from_ = np.where(sparse[owner], self.docs[posting], self.low[owner]) if len(owner) else none
        self.to = np.where(sparse[owner], self.docs[posting], self.high[owner]) if len(owner) else none
        self.most, self.span = self.peak[owner], np.concatenate([[0], np.cumsum(spread)])[self.first]
        self.asked: dict[int, list[int]] = {}
        self.items = {}
        for t, r in enumerate(found.values()):
            for q in r["queries"]:
                self.asked.setdefault(q["row"], []).append(t)
                self.items[q["row"]] = q["item_id"]
        self.read = 0  # postings read, for tests and tuning

    def search(self, row: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Local documents and scores of a query's k best, ties to the lesser document."""
        blocks = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in self.asked[row]])
        low, high = self.low[blocks], self.high[blocks]
        spans = np.concatenate([np.arange(self.span[t], self.span[t + 1]) for t in self.asked[row]])
        rise = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(rise, self.from_[spans], self.most[spans])
        np.subtract.at(rise, self.to[spans] + 1, self.most[spans])
        bound = np.cumsum(rise)[:-1]
        left = np.nonzero(bound > 0)[0]
        left = left[np.argsort(-bound[left], kind="stable")]
        score, member = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        best, points, at, size = np.empty(0, np.int64), np.empty(0, np.int64), 0, 4 * k
        while at < len(left) and (len(best) < k or bound[left[at]] >= points[-1]):
            now = left[at : at + size]
            if len(best) == k:
                now = now[bound[now] >= points[-1]]
            at, size = at + len(now), 4 * size
            member[now] = True
            seen = np.concatenate([[0], np.cumsum(member)])
            covers = np.nonzero(seen[high + 1] > seen[low])[0]
            b = blocks[covers]
            begin, sizes = self.begin[b], self.end[b] - self.begin[b]
            places = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            self.read += len(places)
            docs, values = self.docs[places], self.values[places] * np.repeat(self.weight[b], sizes)
            here = member[docs]
            np.add.at(score, docs[here], values[here])
            member[now] = False
            best = np.concatenate([best, now[score[now] > 0]])
            best = best[np.lexsort((best, -score[best]))][:k]
            points = score[best]
        return best, points


def search(found: Index, items: DataFrame, k: int = 50, query_rows: int = 512) -> DataFrame:
    """The k best documents of each of ``items(item_id, text)``: item_id, rank, doc_id, score."""
    queries = materialize(_query_terms(items), "ranking-queries")
    n_blocks = -(-queries.count() // query_rows)
    block = F.pmod(F.xxhash64("row"), F.lit(max(n_blocks, 1))).cast("int")
    wanted = queries.select(block.alias("block"), F.struct("row", "item_id").alias("query"), F.explode("terms").alias("term"))
    asked = wanted.groupBy("block", "term").agg(F.collect_list("query").alias("queries"))  # query_rows of a block, about
    frequency = found.postings.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    ratio = F.lit(2.0 * found.n_docs + 2.0) / (2.0 * F.col("df") + 1.0)
    weighed = asked.join(frequency.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("weight")), "term")
    ids = asked.select("block").distinct().select("block", F.lit(IDS).cast("binary").alias("term"), F.lit(0).cast("long").alias("weight"), F.array().cast("array<struct<row: long, item_id: long>>").alias("queries"))
    terms_ = materialize(weighed.select("block", "term", "weight", "queries").unionByName(ids), "ranking-terms")
    hits = found.postings.join(terms_, "term")
    result = pa.schema([("row", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        shard, out = Shard(table), []
        for row in sorted(shard.asked):
            docs, points = shard.search(row, k)
            out += [(row, shard.items[row], shard.ids[d], s) for d, s in zip(docs.tolist(), points.tolist())]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], schema=result)

    parts = hits.groupBy("block", "shard").applyInArrow(run, "row long, item_id long, doc_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
