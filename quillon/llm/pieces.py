"""SentencePiece encoding through a table of distinct marked words.

No piece of the vocabulary holds a whitespace mark behind another character, so no merge reaches over
the place before a mark, and a text is the sequence of its marked words (a run of marks and what follows up to the next).
Where no longer piece holds a line's end, that is a border as well.
Each distinct marked word of all texts is segmented once, by the library itself, and its ids are joined back by position:

1. A task cuts its texts into blocks of ``block_words`` words. A block keeps the number of each word, in
   order, and its distinct words, dealt by hash into ``buckets`` rows.
2. Rows of one bucket meet in one task, which holds that bucket's part of the table: words not seen before are
   segmented, and every row gets the ids of its words.
3. The ids of a block's words meet its texts, and every text's ids are laid end to end by the numbers.

What is shuffled is each block's distinct words and ids, and two bytes or so a word of text; texts themselves
never travel. A frequent word is in a block's rows once, so none is hot. A block bounds the memory of
steps 1 and 3, a bucket's distinct words that of step 2; both numbers grow with the data.

A vocabulary with pieces that reach over marks makes every text one word; the ids are right just so.

Defined cases: a null text is empty, an empty text has no ids; a literal mark (U+2581) is a blank to the library
and so it is here; repeated rows and null ids are kept as they are; bytes that are no UTF-8 become U+FFFD
first; an empty table gives an empty result; other columns are ignored. One text is never cut, so a long one is a block alone.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_batches, materialize, shuffle_parts

MARK = "▁"
MARKED = re.compile(" +[^ ]*")
#: With a line's end as a border: it starts a word, which then has no mark.
MARKED_LINES = re.compile("\n[^ \n]*| +[^ \n]*")
#: Words of one call of the library.
CALL_WORDS = 1 << 14
#: Of compression.
LEVEL = 9
SCHEMA = "block long, bucket int, n long, data binary, ids array<long>, sizes array<long>"
ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
#: Bucket of a block's row of texts.
TEXTS = -1


@lru_cache(maxsize=2)
def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def separable(path: str) -> bool:
    """Whether no piece reaches over a whitespace mark, and a lone mark is a piece."""
    model = load_model(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    alone = model.encode("a") == [model.piece_to_id(MARK + "a")] and model.encode("a ")[-1:] == [model.piece_to_id(MARK)]
    return alone and not any(MARK in p.lstrip(MARK) for p in pieces)


@lru_cache(maxsize=2)
def lines_apart(path: str) -> bool:
    """Whether a line's end is part of no longer piece, so that no merge reaches over it either."""
    model = load_model(path)
    return not any("\n" in model.id_to_piece(i)[1:] or model.id_to_piece(i).startswith("\n") for i in range(model.get_piece_size()))


def marked_words(text: str, lines: bool = False) -> list[str]:
    """The marked words of a text, each without its first mark; a mark is a blank. ``lines``: a line's end starts a word without one."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] not in " \n" and text[-1] != " " and " \n" not in text:
        return (text.replace("\n", " \n") if lines else text).split(" ")
    if not lines:
        return [w[1:] for w in MARKED.findall(" " + text)]
    return [w[1:] if w[0] == " " else w for w in MARKED_LINES.findall(" " + text)]


def segment(model, words: list[str], lines: bool = False) -> list[list[int]]:
    """Ids of marked words; the library puts the first mark before each, but for an empty one, and it is taken off again before a line's end."""
    found = []
    for k in range(0, len(words), CALL_WORDS):
        found += model.encode(words[k : k + CALL_WORDS], num_threads=1)
    mark = model.piece_to_id(MARK)
    return [ids[lines and w[:1] == "\n" :] or [mark] for w, ids in zip(words, found)]


def pack_numbers(x: np.ndarray, width: int) -> bytes:
    """Numbers as ``width`` planes of bytes, least first, compressed; small numbers leave the high planes empty."""
    planes = x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    return zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(planes.T).tobytes())


def unpack_numbers(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u4").ravel()


def _pack_words(words: list[str]) -> bytes:
    """Words in order, lengths apart from letters."""
    raw = [w.encode() for w in words]
    sizes = np.ascontiguousarray(np.array([len(r) for r in raw], "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(sizes + b"".join(raw))


def _unpack_words(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()
    ends = 4 * n + np.cumsum(sizes, dtype=np.int64)
    at, out = 4 * n, []
    for end in ends.tolist():
        out.append(raw[at:end])
        at = end
    return out


def _row(block, bucket, n, data, ids=None, sizes=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block, bucket, n, data, ids, sizes), ARROW.types)], schema=ARROW)


def blocks_of(docs: DataFrame, path: str, block_words: int, buckets: int) -> DataFrame:
    """Step 1: a row of texts for each block, and its distinct words by bucket.

    Words are numbered bucket by bucket and in order of bytes there, so the rows of words need not hold numbers.
    """

    def run(batches):
        block, known, numbers, ids, sizes, held = TaskContext.get().partitionId() << 33, {}, [], [], [], 0
        lines = separable(path) and lines_apart(path)
        words_of = (lambda t: marked_words(t, lines)) if separable(path) else lambda t: [t.replace(MARK, " ")] if t else []

        def close():
            nonlocal block, held
            dealt = sorted((zlib.crc32(raw) % buckets, raw, k) for raw, k in ((w.encode(), k) for w, k in known.items()))
            place = np.empty(len(dealt), np.int64)
            place[[k for _, _, k in dealt]] = np.arange(len(dealt))
            a = 0
            while a < len(dealt):
                b, bucket = a, dealt[a][0]
                while b < len(dealt) and dealt[b][0] == bucket:
                    b += 1
                yield _row(block, bucket, b - a, _pack_words([raw.decode() for _, raw, _ in dealt[a:b]]))
                a = b
            every = place[np.concatenate(numbers)] if held else np.empty(0, np.int64)
            # common words get small numbers; the order of all is sent along
            order = np.argsort(-np.bincount(every, minlength=len(dealt)), kind="stable")
            rank = np.empty(len(dealt), np.int64)
            rank[order] = np.arange(len(dealt))
            # words as frequent as one another are in order, so steps are small
            steps = np.diff(order, prepend=0).astype(np.int32)
            data = b"".join(len(x).to_bytes(8, "little") + x for x in (pack_numbers(rank[every], 4), pack_numbers(steps, 4)))
            yield _row(block, TEXTS, len(dealt), data, list(ids), list(sizes))
            block, held = block + 1, 0
            for x in (known, numbers, ids, sizes):
                x.clear()

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
                words = words_of((text.as_py() or b"").decode("utf-8", "replace"))
                if ids and held + len(words) > block_words:
                    yield from close()
                ids.append(doc)
                sizes.append(len(words))
                numbers.append(np.array([known.setdefault(w, len(known)) for w in words], np.int32))
                held += len(words)
        if ids:
            yield from close()

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def word_ids(blocks: DataFrame, path: str) -> DataFrame:
    """Step 2: rows of distinct words, with the ids of the words in place of them; each distinct word is segmented once."""

    def run(batches):
        model, bucket, table, lines = load_model(path), None, {}, separable(path) and lines_apart(path)
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                if r["bucket"] != bucket:
                    bucket, table = r["bucket"], {}
                words = _unpack_words(r["data"], r["n"])
                new = [w for w in words if w not in table]
                for w, ids in zip(new, segment(model, [w.decode() for w in new], lines)):
                    table[w] = np.array(ids, "<u4")
                found = [table[w] for w in words]
                sizes = np.array([len(x) for x in found])
                packed = [pack_numbers(sizes, 4), pack_numbers(np.concatenate(found), 4)]
                yield _row(r["block"], bucket, r["n"], b"".join(len(x).to_bytes(8, "little") + x for x in packed))

    rows = blocks.where(F.col("bucket") != TEXTS).repartition(shuffle_parts(blocks.sparkSession), "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, SCHEMA)


def _two(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return unpack_numbers(data[8 : 8 + n], 4), unpack_numbers(data[16 + n :], 4)


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of ``values``, of those starts and sizes, laid end to end by ``picks``; and the sizes of the picked."""
    taken = sizes[picks]
    return values[np.repeat(starts[picks] - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())], taken


def join_back(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Step 3: (doc_id, ids) of every text, from the rows of texts and those of ids."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows))

        text, parts = None, []
        for r in rows():  # of a block the row of texts comes last
            if r["bucket"] != TEXTS:
                parts.append((r["bucket"], *_two(r["data"])))
                continue
            text, parts = r, sorted(parts, key=lambda p: p[0])
            none = np.empty(0, np.int64)
            sizes, ids = (np.concatenate([p[k] for p in parts]) if parts else none for k in (1, 2))
            sizes = sizes.astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            ranks, steps = _two(text["data"])
            order = np.cumsum(steps.astype(np.int32), dtype=np.int64)
            at = 0
            # some texts at a time
            ends = np.cumsum(text["sizes"])
            first = 0
            while first < len(ends):
                last = max(first + 1, int(np.searchsorted(ends, at + CALL_WORDS * 8)))
                picks = order[ranks[at : ends[last - 1]]]
                all_ids, taken = _gather(ids, starts, sizes, picks)
                upto = np.concatenate([[0], np.cumsum(taken)])
                offsets = upto[np.concatenate([[at], ends[first:last]]) - at].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(all_ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(text["ids"][first:last], pa.int64()), lists], names=["doc_id", "ids"])
                first, at = last, int(ends[last - 1])
            text, parts = None, []

    both = found.select(*SCHEMA_NAMES).unionByName(texts)
    whole = both.repartition(shuffle_parts(texts.sparkSession), "block").sortWithinPartitions("block", F.col("bucket").desc())
    return whole.mapInArrow(run, "doc_id long, ids array<int>")


SCHEMA_NAMES = ARROW.names


def encode(docs: DataFrame, model: str, block_words: int = 1 << 23, buckets: int | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``docs(doc_id, text)``, as the library's ``encode``. ``model``: path, the same on every machine."""
    buckets = buckets or shuffle_parts(docs.sparkSession)
    blocks = materialize(blocks_of(docs, model, block_words, buckets), "pieces-blocks")
    return join_back(blocks.where(F.col("bucket") == TEXTS), word_ids(blocks, model))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Add ``text``, the library's ``decode`` of ``encoded(doc_id, ids)``; null ids are none."""

    def run(batches):
        sp = load_model(model)
        for batch in batches:
            ids = batch.column("ids")
            texts = [sp.decode(x.as_py() or []) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    arrow_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
