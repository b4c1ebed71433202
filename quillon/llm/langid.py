"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled texts. A text is parsed whole and greedily
into the longest phrases that occur in the sample; phrases * log2(sample size) / text length estimates its cross
entropy, and the language with the least wins. Texts and samples are lower-cased, what stands between letters is one
blank, and the symbols are the UTF-8 bytes of that, so no script has letters that count for less. A byte that no
sample holds is a phrase of its own. The parse needs only the transitions: a table with one entry per (state, symbol)
holds the next state and whether a phrase begins with the symbol, and all texts of a batch advance one symbol at a
time through all automata at once.

Long texts advance in blocks. Each is parsed as if a phrase began with it, and again from the state that the block
before it ends in, until both parses are in one state, from where on they are the same; where they never are, the
blocks behind are done again. So counts are those of the whole text in one go.

The sample: of the (id, text) pairs of a language the one of least hash in each of 4 * ``docs_per_language`` classes of
hashes, of these the ``docs_per_language`` of least hash, texts over ``sample_bytes`` characters last, shortest first;
whole texts in that order as long as their bytes together stay within ``sample_bytes`` (and within an equal share
of ``total_bytes``, if there are many languages). Where even the first is longer, it is taken alone; of one over that equal share, pieces from
all its length, of the least hashes, take its place, so all samples together are never over ``total_bytes``. The driver sees that sample, first as hashes and lengths, builds the table, and broadcasts it: at most two states a byte of
``total_bytes``, times the symbols, of four bytes. Texts are never shuffled but those of the sample.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing could be
learned; null languages and texts without a letter are not learned; rows with a null id are learned like any other;
repeated rows are learned once; of equal entropies the first language in alphabetical order wins; the score is one less
the ratio of the best entropy to the second, 1 if only one language is known; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_batches

BLOCK = 1024
GAPS = re.compile(r"[\W\d_]+")
#: Stands between the texts of a sample and occurs in no normalised text.
BORDER = "\n"


def normal(text: str) -> str:
    return GAPS.sub(" ", text.lower())


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; the root is state 0."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        now = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 != length[q]:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[now] = q
        last = now
    return step


class Parser:
    """The joint parsing table of all languages."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        held = {name: text.encode("utf-8", "replace") for name, text in samples}
        known = sorted({c for text in held.values() for c in text})
        self.names, self.width = list(held), len(known) + 1
        self.symbol = np.zeros(256, np.uint8 if len(known) < 256 else np.uint16)  # 0: in no sample
        self.symbol[known] = np.arange(1, self.width)
        self.bits = np.array([np.log2(max(len(t), 2)) for t in held.values()])
        tables, starts, at = [], [], 0
        most = sum(2 * len(text) + 2 for text in held.values())  # states of all automata
        kind = np.int32 if 2 * most * self.width < 2**31 else np.int64
        for text in held.values():
            states = suffix_automaton(text)
            step = np.full((len(states) + 1, self.width), -1, kind)  # the last state, where a parse begins, goes nowhere
            for k, to in enumerate(states):
                step[k, self.symbol[list(to)]] = list(to.values())
            fresh = step[0] >= 0
            begins = step < 0
            # where a phrase can't go on the symbol begins the next one; an unknown symbol is one
            first = np.where(fresh, step[0], len(states)).astype(kind)
            step = np.where(begins, first[None, :], step)
            step += at
            step *= 2 * self.width
            step |= begins
            tables.append(step.ravel())
            starts.append((at + len(states)) * self.width)
            at += len(states) + 1
        self.table, self.starts = np.concatenate(tables), np.array(starts, kind)

    def encode(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(normal(text).encode("utf-8", "replace"), np.uint8)]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(language, text) numbers of greedy longest phrases."""
        sizes = np.array([len(t) for t in texts], np.int64)
        symbols = np.concatenate([*texts, np.empty(0, self.symbol.dtype)])
        owner = np.repeat(np.arange(len(texts)), -(-sizes // BLOCK))
        if not len(owner):
            return np.zeros((len(self.names), len(texts)), np.int64)
        ends = np.cumsum(sizes)
        first = np.append(True, owner[1:] != owner[:-1])
        nth = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
        begin = (ends - sizes)[owner] + nth * BLOCK
        size = np.minimum(begin + BLOCK, ends[owner]) - begin
        # every block as if a phrase began with it, the longest first so that those at work are the first ones
        order = np.argsort(-size, kind="stable")
        state = np.repeat(self.starts[:, None], len(order), axis=1)
        count = np.zeros(state.shape, np.int64)
        live = np.searchsorted(-size[order], -np.arange(int(size.max())), side="left")
        for t, n in enumerate(live.tolist()):
            got = self.table[state[:, :n] + symbols[begin[order[:n]] + t]]
            count[:, :n] += got & 1
            state[:, :n] = got >> 1
        back = np.argsort(order, kind="stable")
        count, alone = count[:, back], state[:, back]
        end = alone.copy()
        # and from where the block before it ends
        extra = np.zeros_like(count)
        lang, block = (x.ravel() for x in np.meshgrid(np.arange(len(self.names)), np.nonzero(~first)[0], indexing="ij"))
        while len(block):
            true, guess, more = end[lang, block - 1].copy(), self.starts[lang].copy(), np.zeros(len(block), np.int64)
            at_work, t = np.nonzero(true != guess)[0], 0
            while len(at_work):
                seen = symbols[begin[block[at_work]] + t]
                a, b = self.table[true[at_work] + seen], self.table[guess[at_work] + seen]
                more[at_work] += (a & 1).astype(np.int64) - (b & 1)
                true[at_work], guess[at_work] = a >> 1, b >> 1
                t += 1
                at_work = at_work[((a >> 1) != (b >> 1)) & (size[block[at_work]] > t)]
            extra[lang, block] = more
            known = np.where(true == guess, alone[lang, block], true)
            changed = end[lang, block] != known
            end[lang, block] = known
            lang, block = lang[changed], block[changed] + 1
            inside = block < len(owner)
            inside[inside] = ~first[block[inside]]
            lang, block = lang[inside], block[inside]
        total = np.zeros((len(self.names), len(texts)), np.int64)
        for k in range(len(self.names)):
            np.add.at(total[k], owner, count[k] + extra[k])
        return total


def within(text: str, most: int, size: int = 1024) -> str:
    """A text of at most ``most`` bytes whole; else pieces of it, of ``size`` characters and less, of the least hashes, in their order."""
    if len(text.encode("utf-8", "replace")) <= most:
        return text
    pieces = [text[k : k + size] for k in range(0, len(text), size)]
    drawn, left = [], most
    for k in sorted(range(len(pieces)), key=lambda k: hashlib.md5(f"{k}:{pieces[k]}".encode("utf-8", "replace")).digest()):
        n = len(pieces[k].encode("utf-8", "replace")) + 1
        if n > left:
            break
        drawn, left = [*drawn, k], left - n
    return BORDER.join(pieces[k] for k in sorted(drawn)) or text[:1]


def sample(docs: DataFrame, docs_per_language: int, sample_bytes: int, total_bytes: int) -> tuple[tuple[str, str], ...]:
    """(language, normalised texts) of the bounded training sample of ``docs(doc_id, text, lang)``."""
    slim = docs.where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    slim = slim.select("lang", F.octet_length("text").alias("n"), F.xxhash64("doc_id", "text").alias("h"), "text")
    long = F.when(F.col("n") > sample_bytes, F.col("n")).otherwise(0).alias("long")
    cell = F.pmod("h", F.lit(4 * docs_per_language)).alias("cell")
    least = slim.select("lang", cell, F.struct(long, "h", "n").alias("r")).groupBy("lang", "cell").agg(F.min("r").alias("r"))
    listed = least.select("lang", "r.*").collect()  # 4 * docs_per_language rows a language
    equal = total_bytes // max(1, len({r["lang"] for r in listed}))
    share = min(sample_bytes, equal)
    picked, held, rank = [], {}, {}
    for r in sorted(listed, key=lambda r: (r["lang"], r["long"], r["h"])):
        rank[r["lang"]] = rank.get(r["lang"], 0) + 1
        if rank[r["lang"]] <= docs_per_language and (r["lang"] not in held or held[r["lang"]] + r["n"] <= share):
            held[r["lang"]] = held.get(r["lang"], 0) + r["n"]
            picked.append((r["lang"], r["h"], rank[r["lang"]]))
    if not picked:
        return ()
    chosen = docs.sparkSession.createDataFrame(picked, "lang string, h long, rank int")  # docs_per_language rows a language
    rows = slim.select("lang", "h", "text").join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "rank", "text")

    def cut(batches):
        for batch in batches:
            found = [within(normal(t), equal) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(found, pa.string())], names=["lang", "rank", "text"])

    rows = rows.mapInArrow(cut, "lang string, rank int, text string").groupBy("lang", "rank").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return tuple((name, BORDER.join(found)) for name, found in texts.items())


def identify(
    docs: DataFrame, train: Column, docs_per_language: int = 64, sample_bytes: int = 1 << 15, total_bytes: int = 1 << 18
) -> DataFrame:
    """doc_id, lang_pred and score for every row; learned from the rows where ``train`` holds."""
    arrow_batches(docs.sparkSession)
    learned = sample(docs.where(train).select("doc_id", "text", F.col("lang").cast("string").alias("lang")), docs_per_language, sample_bytes, total_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(Parser(learned) if learned else None)  # its size follows from total_bytes

    def run(batches):
        for batch in batches:
            whole = [t or "" for t in batch.column("text").to_pylist()]
            pred, score = ["und"] * len(whole), [0.0] * len(whole)
            known = shared.value
            rows = [k for k, t in enumerate(whole) if any(map(str.isalpha, t))] if known else []
            if rows:
                coded = [known.encode(whole[k]) for k in rows]
                entropy = known.phrases(coded) * known.bits[:, None] / np.array([len(c) for c in coded])
                ranked = np.sort(entropy, axis=0)
                for k, best, one, two in zip(rows, entropy.argmin(axis=0), ranked[0], ranked[min(1, len(known.names) - 1)]):
                    pred[k], score[k] = known.names[best], float(1 - one / two) if len(known.names) > 1 else 1.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")
