"""Substring dedup by sliding sentence spans.

A text is cut behind each sentence; a sentence of more than ``long_words`` words is cut further, behind words chosen by
their hash (one in ``one_in``) and behind a word that stands twice in a row, so that a passage pasted into a sentence has whole parts of its own, one long sentence
is a run of several, and so is one word said over and over. Each part begins a span and ends one: the shortest run of at least ``run_parts`` consecutive parts
with at least ``run_words`` words. So a repeated run of that size or more, however long, is covered to its last part.

Spans are compared by a 128-bit hash of their words, lower-cased in A-Z. They are put in order by hash, then place
(doc_id, hash of the text, part), by range partitions, and each is compared with its neighbour: of equal spans the first
is the one of the least place; the parts of every other one are removed. The order splits a span of any number of
copies, and what stands at the border of two partitions is settled by one row a partition (see ``neighbours``). Texts
are parsed once for their spans and shuffled once, to be joined with the parts they lose.

Defined cases: null stays null; a text without words is returned as it is; rows of equal doc_id and text are one
document and share its fate; a null doc_id sorts before all others; an empty table gives an empty result; other columns
are returned as they were.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_batches, texts
from quillon.llm.neighbours import NULL_ID, ORDER, Words, named, neighbours, text_key

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Spans after which a batch of them is closed.
SPANS = 1 << 16


def parts(text: bytes, long_words: int, one_in: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a text, and the first word of each part and the one behind its last."""
    found, lines = [], []
    for line in text.lower().split(b"\n"):
        found += line.split()
        lines.append(len(found))
    words, n = Words(found), len(found)
    cut = np.zeros(n + 1, bool)
    cut[lines] = True
    cut[1:] |= np.fromiter((w[-1] in b".!?" for w in found), bool, n)
    cut[n] = True
    at = np.nonzero(cut[1:])[0] + 1  # ends of sentences
    size = np.diff(at, prepend=0)
    again = np.zeros(n, bool)
    again[1:] = (words.lanes[0][1:n] == words.lanes[0][: n - 1]) & (words.lanes[1][1:n] == words.lanes[1][: n - 1]) if n else False
    inner = (np.repeat(size, size) > long_words) & ((words.lanes[0] % np.uint64(one_in) == 0) | again)
    cut[1:] |= inner
    end = np.nonzero(cut[1:])[0] + 1
    return words, np.concatenate([[0], end[:-1]]).astype(np.int64) if n else end, end


def spans(begin: np.ndarray, end: np.ndarray, run_parts: int, run_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First part of each span and the one behind its last."""
    n = len(begin)
    at = np.arange(n)
    last = np.maximum(at + run_parts - 1, np.searchsorted(end, begin + run_words))  # shortest that begins with a part
    first = np.minimum(at - run_parts + 1, np.searchsorted(begin, end - run_words, side="right") - 1)  # that ends with one
    ahead, back = last < n, first >= 0
    pairs = np.concatenate([at[ahead] * (n + 1) + last[ahead], first[back] * (n + 1) + at[back]])
    pairs = np.unique(pairs)
    return pairs // (n + 1), pairs % (n + 1) + 1


def covered(gone: pa.ListArray, k: int, n: int) -> np.ndarray:
    """Which of the ``n`` parts of the text in row ``k`` lie in one of its spans of ``gone``; the spans stay in Arrow's buffers, 8 bytes each."""
    a, b = gone.offsets[k].as_py(), gone.offsets[k + 1].as_py()
    begin, end = (np.bincount(gone.values.field(c)[a:b].to_numpy(zero_copy_only=False), minlength=n + 1) for c in ("begin", "end"))
    return np.cumsum(begin - end)[:n] > 0


def in_batches(rows, names: list[str], most: int = SPANS):
    """Record batches of the columns of ``rows`` (a tuple of arrays each), closed at ``most`` rows."""
    held, n = [], 0
    for columns in rows:
        held.append(columns)
        n += len(columns[0])
        if n >= most:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)


def dedup_spans(
    docs: DataFrame, run_parts: int = 2, run_words: int = 6, long_words: int = 12, one_in: int = 8
) -> DataFrame:
    """``docs`` as columns ``doc`` (a struct of all its own), text, n_parts (null where nothing is removed), n_removed."""
    arrow_batches(docs.sparkSession)

    def every(batches):
        def found(batch):
            for id_, key, text in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), texts(batch)):
                words, begin, end = parts(text, long_words, one_in)
                a, b = spans(begin, end, run_parts, run_words)
                if len(a):
                    run, h = (words.run(begin[a], end[b - 1], lane).view(np.int64) for lane in (0, 1))
                    yield run, h, np.full(len(a), id_), np.full(len(a), key), a.astype(np.int32), b.astype(np.int32)

        for batch in batches:
            yield from in_batches(found(batch), [*ORDER, "end"])

    found = named(docs).mapInArrow(every, "run long, h long, id long, key long, begin int, end int")
    again, _ = neighbours(found.withColumn("at", F.lit(0)), "spans", tests=False)
    gone = again.groupBy("id", "key").agg(F.collect_set(F.struct("begin", "end")).alias("gone"))

    def cut(batches):
        for batch in batches:
            kept, total, removed, gone = [], [], [], batch.column("gone")
            loses = np.diff(gone.offsets.to_numpy()) > 0
            for row, text in enumerate(texts(batch)):
                total.append(None)
                removed.append(0)
                if loses[row]:
                    _, begin, _ = parts(text, long_words, one_in)
                    drop = covered(gone, row, len(begin))
                    total[-1], removed[-1] = len(begin), int(drop.sum())
                    spots = [m.start() for m in WORD.finditer(text)]
                    cuts = [0, *(spots[k] for k in begin[1:].tolist()), len(text)]
                    text = b"".join(text[a:b] for a, b, c in zip(cuts, cuts[1:], drop) if not c)
                kept.append(text.decode())
            kept = pa.array(kept, pa.string())
            kept = pa.compute.if_else(batch.column("text").is_null(), pa.scalar(None, pa.string()), kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), kept, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=["doc", "text", "n_parts", "n_removed"])

    others = [c for c in docs.columns if c != "text"]
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")
    whole = docs.select(F.struct(*others).alias("doc"), "text", id_, text_key().alias("key"))
    schema = whole.select("doc", "text").withColumns({"n_parts": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    for field in schema:
        field.nullable = True
    return whole.join(gone, ["id", "key"], "left").select("doc", "text", "gone").mapInArrow(cut, schema)


def remove_repeated_spans(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated spans taken out of ``text`` (and ``n_chars`` brought up to date).

    Rows that lose their last word go; rows that had no words stay.
    """
    found = dedup_spans(docs, **options).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_parts")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("doc.n_chars"))
    return found.select(*[changed[c].alias(c) if c in changed else F.col("doc").getField(c).alias(c) for c in docs.columns])
