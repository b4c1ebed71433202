"""Repeated passages by a sparse suffix array.

Texts are sequences of words (A-Z lower-cased, any white space). Of each text only the suffixes at minimiser positions
are retained: the least hash of a ``gram``-word run among every ``window`` consecutive ones. Each passage of
``min_words`` words is so assigned to the retained suffix at the minimiser of its first ``window`` runs, wherever it
stands: the passages of one suffix begin up to window - 1 words to its left, and two copies of a passage are assigned
to suffixes that share ``reach`` = min_words - window + 1 words at least.

1. The retained suffixes are put in order by range partitions: by their first ``reach`` words, then by all words of
   their passages, left and right, then by place. In that order each is compared with its neighbour. One whose words all
   equal those before it repeats the first of that block, from its leftmost passage to the end of its rightmost. Where
   neighbours share the first words only, the heads of both blocks are kept for
2. the extension to left and right: the passages of each such suffix, every one of min_words words about it, are put in
   order and compared with their neighbours in the same way.

What repeats is merged within each document. Result: exactly the words that lie in a passage of min_words words that
stood at a lesser place (doc_id, hash of the text, word).

Words are compared by 128-bit hashes, in an order by hash. Range partitions split a block of any size, as a place is
part of the order; where a block goes on from one partition to the next, its first place is passed on by the driver,
which sees one row a partition. Nothing is joined on a hash of words. Texts are shuffled once, to those that have a suffix to
extend.

Defined cases: null and short texts have no passages; rows of equal doc_id and text are one document; a null doc_id
sorts first (a doc_id of -2**63 counts as null); within one document a passage may repeat too; an empty table gives an
empty result; other columns are ignored by ``repeated_passages`` and kept by ``cut_passages``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_batches, materialize, texts
from quillon.llm.neighbours import NULL_ID, ORDER, Words, named, neighbours, text_key


def minimisers(words: Words, min_words: int, window: int, gram: int) -> np.ndarray:
    """Position of the retained suffix that each passage of ``min_words`` words, by its begin, is assigned to."""
    at = np.arange(words.n - (min_words - window - gram + 1) - gram + 1)
    order = words.run(at, at + gram)
    return np.lib.stride_tricks.sliding_window_view(order, window).argmin(axis=1) + np.arange(words.n - min_words + 1)


ROWS = "run long, h long, id long, key long, begin int, end int, at int"


def _rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = [np.int64] * 4 + [np.int32] * 3
    arrays = [pa.array(c.view(k) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=[*ORDER, "end", "at"])


def repeats(docs: DataFrame, min_words: int, window: int, gram: int) -> DataFrame:
    """id, key, begin, end (words), first_id, first_begin of what stood before; parts may overlap."""
    arrow_batches(docs.sparkSession)
    reach = min_words - window + 1
    assert gram + window - 1 <= min_words and gram <= reach
    base = named(docs)

    def retain(batches):
        for batch in batches:
            out = []
            for id_, key, text in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), texts(batch)):
                words = Words(text.lower().split())
                if words.n < min_words:
                    continue
                at, begin, count = np.unique(minimisers(words, min_words, window, gram), return_index=True, return_counts=True)
                end, n = begin + count - 1 + min_words, len(at)
                out.append((words.run(at, at + reach), words.run(begin, end, 1), np.full(n, id_), np.full(n, key), begin, end, at))
            if out:
                yield _rows([np.concatenate(c) for c in zip(*out)])

    suffixes = base.mapInArrow(retain, ROWS)
    equal, heads = neighbours(suffixes, "suffixes", tests=True)
    heads = heads.groupBy("id", "key").agg(F.collect_set("at").alias("ats"))

    def extend(batches):
        seen = set()
        for batch in batches:
            for id_, key, text, ats in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), texts(batch), batch.column("ats")):
                if (id_, key) in seen:
                    continue
                seen.add((id_, key))
                words = Words(text.lower().split())
                begin = np.nonzero(np.isin(minimisers(words, min_words, window, gram), ats.values.to_numpy()))[0]
                end, n = begin + min_words, len(begin)
                yield _rows([words.run(begin, end), words.run(begin, end, 1), np.full(n, id_), np.full(n, key), begin, end, begin])

    passages = base.join(heads, ["id", "key"]).mapInArrow(extend, ROWS)
    more, _ = neighbours(passages, "passages", tests=False)
    return equal.unionByName(more)


def repeated_passages(docs: DataFrame, min_words: int = 50, window: int = 24, gram: int = 8) -> DataFrame:
    """key, doc_id, begin, end, first_doc_id, first_begin of each passage that stood somewhere before.

    ``begin`` and ``end`` count words; first_* tell where the longest part of the passage stood first.
    """
    found = repeats(docs, min_words, window, gram)
    mine = found.groupBy("id", "key").agg(F.collect_list(F.struct("begin", "end", "first_id", "first_begin")).alias("parts"))

    def merge(batches):
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        real = lambda x: None if x == NULL_ID else x
        for batch in batches:
            out = []
            for id_, key, parts in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "parts"))):
                parts = sorted((p["begin"], p["end"], p["first_begin"], p["first_id"]) for p in parts)
                k = 0
                while k < len(parts):
                    begin, end = parts[k][:2]
                    j, best = k + 1, parts[k]
                    while j < len(parts) and parts[j][0] <= end:
                        end = max(end, parts[j][1])
                        best = max(best, parts[j], key=lambda p: p[1] - p[0])
                        j += 1
                    out.append((key, real(id_), begin, end, real(best[3]), best[2]))
                    k = j
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "begin", "end", "first_doc_id", "first_begin"])

    return mine.mapInArrow(merge, "key long, doc_id long, begin int, end int, first_doc_id long, first_begin int")


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the words of ``passages``; white space around a cut becomes a line end."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")
    mine = passages.groupBy(id_, "key").agg(F.collect_set(F.struct("begin", "end")).alias("cuts"))

    def cut(batches):
        import re

        for batch in batches:
            out = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                if cuts and text:
                    spots = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
                    kept, at = [], 0
                    for c in sorted(cuts, key=lambda c: c["begin"]):
                        kept.append(text[at : spots[c["begin"]][0]].rstrip(" \t\n\r\x0b\x0c"))
                        at = spots[c["end"]][0] if c["end"] < len(spots) else len(text)
                    text = "\n".join([*(k for k in kept if k), text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.string())], names=["doc", "text"])

    whole = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), "text", id_, text_key().alias("key"))
    schema = whole.select("doc", "text").schema
    done = whole.join(mine, ["id", "key"], "left").select("doc", "text", "cuts").mapInArrow(cut, schema)
    return done.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
