"""Cost-balanced packing of token streams into fixed-length training sequences.

Every document becomes its token ids plus one end id. Whole runs of ``capacity`` ids are
sequences of their own. What is left of each document is packed block by block inside the
scan task: pieces go, in descending order of estimated attention cost, to the cheapest
sequence that still has room. A block opens only as many sequences as its tokens need, so
a piece that no sequence has room for is cut, and padding stays below one sequence per block.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n``; that of a sequence is
the sum over its pieces, since packed documents do not attend to one another.

No shuffle: a block is a run of consecutive rows of one input split, so a hot source, equal
texts or one huge text change nothing but the number of pieces. Memory holds one block.

Defined cases: a null or empty text is the end id alone; a run of white space of any length is encoded; the
string of an added token is that token, as ``tokenizers`` has it;
repeated rows are packed as often as
they occur; a null id stays null; columns other than the two named are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_batches

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, sequence_cost double, token_ids binary"
)


@lru_cache(maxsize=2)
def load_encoder(path: str):
    """A byte-pair encoder built from a ``tokenizers`` JSON file of a byte-level model.

    The ids are those of ``tokenizers`` itself (tests compare them); this encoder needs a
    quarter of the time.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # printable stand-ins of the 256 bytes, as the byte-level scheme deals them out
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    assert set(byte_of) == set(ByteLevel.alphabet())
    ranks = {
        bytes(byte_of[c] for c in token): k
        for token, k in model["vocab"].items()
        if all(c in byte_of for c in token) and (len(token) == 1 or not token.startswith("<|"))
    }
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def added_tokens(path: str) -> dict[str, int]:
    """Strings that ``tokenizers`` finds in a text before anything else, and their ids."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError(f"an added token of {path} takes what is beside it")
    return {t["content"]: t["id"] for t in tokens}


#: White space of the encoder's pattern, in runs too long for the stack of its regular expressions.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def _encode(encoder, text: str) -> list[int]:
    """Ids of a text. A long run of white space is a token sequence of its own but for its last character, which the word after it may take."""
    ids, at = [], 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        ids += encoder.encode_ordinary(text[at : m.start()])
        ids += encoder._encode_single_piece(text[m.start() : end])
        at = end
    return ids + encoder.encode_ordinary(text[at:]) if at else encoder.encode_ordinary(text)


def encode(encoder, text: str, added: dict[str, int]) -> list[int]:
    """Ids of a text: added tokens, the longest where several begin, and between them ordinary text, each part for itself."""
    if not any(token in text for token in added):
        return _encode(encoder, text)
    ids, at = [], 0
    for m in re.finditer("|".join(map(re.escape, sorted(added, key=len, reverse=True))), text):
        ids += [*_encode(encoder, text[at : m.start()]), added[m.group()]]
        at = m.end()
    return ids + _encode(encoder, text[at:])


class Rooms:
    """Open sequences by room: for each room a heap by cost, over them a tree of the cheapest."""

    NONE = (float("inf"), -1)

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(capacity + 1)]
        self.tree = [self.NONE] * (2 * self.size)

    def _renew(self, room: int) -> None:
        at = room + self.size
        self.tree[at] = self.heaps[room][0] if self.heaps[room] else self.NONE
        while at > 1:
            at //= 2
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def add(self, room: int, cost: float, k: int) -> None:
        heapq.heappush(self.heaps[room], (cost, k))
        self._renew(room)

    def take(self, least: int, room: list[int]) -> int | None:
        """The cheapest sequence with at least that room, removed."""
        a, b, best = least + self.size, 2 * self.size, self.NONE
        while a < b:
            if a & 1:
                best = min(best, self.tree[a])
                a += 1
            if b & 1:
                b -= 1
                best = min(best, self.tree[b])
            a, b = a // 2, b // 2
        if best[1] < 0:
            return None
        heapq.heappop(self.heaps[room[best[1]]])
        self._renew(room[best[1]])
        return best[1]

    def greatest(self) -> int:
        """The greatest room of an open sequence."""
        at = 1
        while at < self.size:
            at = 2 * at + (self.tree[2 * at + 1][1] >= 0)
        return at - self.size


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float):
    """Assign pieces to sequences; returns per sequence its (piece, begin, length) parts and its cost.

    Pieces go in descending cost to the cheapest sequence with room. One longer than the greatest room left fills
    the cheapest sequence of that room, and its rest takes its turn among the others.
    """
    n = -(-sum(lengths) // capacity)
    room, cost, parts, open_ = [capacity] * n, [0.0] * n, [[] for _ in range(n)], Rooms(capacity)
    for k in range(n):
        open_.add(capacity, 0.0, k)
    todo = [(-(linear * m + quadratic * m * m), i, 0, m) for i, m in enumerate(lengths) if m]
    heapq.heapify(todo)
    while todo:
        _, i, begin, m = heapq.heappop(todo)
        take, k = m, open_.take(m, room) if m <= capacity else None
        if k is None:
            take = open_.greatest()
            k = open_.take(take, room)
        parts[k].append((i, begin, take))
        room[k] -= take
        cost[k] += linear * take + quadratic * take * take
        if room[k]:
            open_.add(room[k], cost[k], k)
        if rest := m - take:
            heapq.heappush(todo, (-(linear * rest + quadratic * rest * rest), i, begin + take, rest))
    return parts, cost


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length")
    arrays = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:7]]
    arrays.append(pa.array([r[7] for r in rows], pa.float64()))
    arrays.append(pa.array([r[8] for r in rows], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_cost", "token_ids"])


def _packer(path, capacity, end_id, linear, quadratic, block_tokens):
    def run(batches):
        encoder, added = load_encoder(path), added_tokens(path)
        sequence = TaskContext.get().partitionId() << 36
        end = np.array([end_id], dtype="<u4")
        full_cost = linear * capacity + quadratic * capacity * capacity
        block, held, out = [], 0, []

        def pack():
            nonlocal sequence
            lengths = [len(ids) for _, ids, _, _ in block]
            parts, cost = balance(lengths, capacity, linear, quadratic)
            for members, c in zip(parts, cost):
                size, offset = sum(m for _, _, m in members), 0
                for i, begin, m in members:
                    doc, ids, start, total = block[i]
                    out.append((doc, start + begin, m, total, sequence, offset, size, c, ids[begin : begin + m].tobytes()))
                    offset += m
                sequence += 1
            block.clear()

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.concatenate([np.array(encode(encoder, text.as_py() or "", added), dtype="<u4"), end])
                total = len(ids)
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    out.append((doc, start, capacity, total, sequence, 0, capacity, full_cost, ids[start : start + capacity].tobytes()))
                    sequence += 1
                    if len(out) >= 4096:
                        yield _emit(out)
                        out.clear()
                if whole < total:
                    block.append((doc, ids[whole:].copy(), whole, total))
                    held += total - whole
                if held >= block_tokens:
                    pack()
                    held = 0
            if len(out) >= 1024:
                yield _emit(out)
                out.clear()
        pack()
        for k in range(0, len(out), 4096):
            yield _emit(out[k : k + 4096])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    block_tokens: int = 1 << 21,
) -> DataFrame:
    """Pack ``docs(doc_id, text)``; one row per piece with its ids as little-endian uint32 bytes.

    ``tokenizer``: path of the vocabulary file, the same on every machine. ``linear`` and
    ``quadratic``: weights of the attention cost. ``block_tokens``: left-over tokens packed together.
    """
    arrow_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(_packer(tokenizer, capacity, end_id, linear, quadratic, block_tokens), SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "sequence_length", "sequence_cost",
    )
