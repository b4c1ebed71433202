"""Sequential scans of texts and id lists that no expression states: Arrow functions over batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = re.compile(r"<t>\s*([0-9]+(?:\.[0-9]+)?)s\s*-\s*([0-9]+(?:\.[0-9]+)?)s\s*</t>", re.I)
# Marks of assistant turns and of their ends in rendered chats, and the tags of what is learned.
TURN = re.compile(r"(?:<\|im_start\|>assistant|<start_of_turn>model|<\|assistant\|>)\n{0,2}(.*?)(?:<\|im_end\|>|<end_of_turn>|</s>|\Z)", re.S)
LEARNED = re.compile(r"<think>.*?</think>(?:.*?<answer>.*?</answer>)?|<answer>.*?</answer>", re.S)
CLOSE = re.compile(r"\s*(?:<\|im_end\|>|<end_of_turn>|</s>)?")
INT = T.IntegerType()
PAIR = T.ArrayType(T.StructType([T.StructField("begin", INT), T.StructField("end", INT)]))
MENTION = T.ArrayType(
    T.StructType(
        [T.StructField("noun", T.StringType()), T.StructField("start_sec", T.DoubleType()), T.StructField("end_sec", T.DoubleType()), T.StructField("begin", INT), T.StructField("end", INT)]
    )
)


class Patterns:
    """Words looked for in one pass over a text, by an automaton that grows with the words it is given."""

    #: Words held at most between two texts.
    MOST = 1 << 20

    def __init__(self, words=()):
        self._clear()
        self.add(words)

    def _clear(self):
        import ahocorasick

        self.known, self.trie = set(), ahocorasick.Automaton()

    def add(self, words) -> None:
        new = {w for w in words if w} - self.known
        if new and len(new) + len(self.known) > self.MOST:
            self._clear()
        for word in new:
            self.trie.add_word(word, word)
        self.known |= new
        if new:
            self.trie.make_automaton()

    def spots(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Where each word stands, from left to right; a word doesn't overlap itself."""
        found: dict[str, list[tuple[int, int]]] = {}
        for last, word in self.trie.iter(text) if self.known else ():
            begin, spots = last + 1 - len(word), found.setdefault(word, [])
            if not spots or spots[-1][1] <= begin:
                spots.append((begin, last + 1))
        return found


def noun_mentions(text: str, nouns, patterns: Patterns | None = None) -> list[dict]:
    """Mentions of nouns with the last time range before each, in text order.

    A noun listed k times gets its first k mentions, and none at all if no range stands before the first.
    ``patterns``: holds these nouns, and others.
    """
    ranges = list(RANGE.finditer(text))
    ends = [r.end() for r in ranges]
    wanted = nouns if isinstance(nouns, Counter) else Counter(n for n in (nouns if nouns is not None else ()) if n)
    if not ends or not wanted:
        return []
    found = []
    for noun, spots in (patterns or Patterns(wanted)).spots(text).items():
        if spots[0][0] < ends[0]:
            continue
        for begin, end in spots[: wanted[noun]]:
            last = ranges[bisect_right(ends, begin) - 1]
            found.append({"noun": noun, "start_sec": float(last[1]), "end_sec": float(last[2]), "begin": begin, "end": end})
    return sorted(found, key=lambda m: (m["begin"], m["end"]))


def place_boxes(text: str, mentions) -> str:
    """Writes time and box behind each mention (noun, start_sec, box): the next one without a box from the last written on, else the first."""
    done = 0
    for m in mentions if mentions is not None else ():
        if m["box"] is None:
            continue
        spots = [s.span(1) for s in re.finditer(rf"({re.escape(m['noun'])})(?!\s+at\s+<t>[0-9]+(?:\.[0-9]+)?s</t>\s*<box>)", text)]
        spot = next((s for s in spots if s[0] >= done), spots[0] if spots else None)
        if spot:
            put = f"{m['noun']} at <t>{m['start_sec']:.1f}s</t><box>{[int(b) for b in m['box']]}</box>"
            text, done = text[: spot[0]] + put + text[spot[1] :], spot[0] + len(put)
    return text


def label_spans(text: str) -> list[tuple[int, int]]:
    """Parts to learn from: think blocks with the answer behind them, or answers alone, with the end mark that follows.

    Only what assistants say counts; the whole text if no turn of theirs is marked.
    """
    turns = [m.span(1) for m in TURN.finditer(text) if m[1]] or [(0, len(text))]
    parts = (m for begin, end in turns for m in LEARNED.finditer(text, begin, end))
    return [(m.start(), CLOSE.match(text, m.end()).end()) for m in parts]


def find_pattern(ids, pattern) -> list[int]:
    """Where a run of ids occurs in another, overlaps included; the search is the linear one of bytes."""
    ids, pattern = (np.asarray(x if x is not None else (), np.int64) for x in (ids, pattern))
    if not len(pattern) or len(pattern) > len(ids):
        return []
    data, wanted, out = ids.tobytes(), pattern.tobytes(), []
    at = data.find(wanted)
    while at >= 0:
        if at % 8 == 0:
            out.append(at // 8)
        at = data.find(wanted, at + 1)
    return out


@F.pandas_udf(MENTION)
def noun_mentions_udf(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(text, nouns): one automaton a task, one pass a text."""
    patterns = Patterns()
    for text, nouns in columns:
        lists = [[w for w in n if w] if n is not None else [] for n in nouns]
        patterns.add({w for n in lists for w in n})
        yield pd.Series([noun_mentions(t or "", n, patterns) for t, n in zip(text, lists)])


def dictionary_mentions(df: DataFrame, text: str, nouns: list[str]) -> DataFrame:
    """``mentions``: those of every noun of a dictionary, which is shipped once and held as one automaton a task."""
    shared = df.sparkSession.sparkContext.broadcast(nouns)

    def run(batches):
        patterns, wanted = Patterns(shared.value), Counter(n for n in shared.value if n)
        for pdf in batches:
            yield pdf.assign(mentions=[noun_mentions(t or "", wanted, patterns) for t in pdf[text]])

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("mentions", MENTION)]))


@F.pandas_udf(T.StringType())
def place_boxes_udf(text: pd.Series, mentions: pd.Series) -> pd.Series:
    return pd.Series([place_boxes(t or "", m) for t, m in zip(text, mentions)])


@F.pandas_udf(PAIR)
def label_spans_udf(text: pd.Series) -> pd.Series:
    return pd.Series([[{"begin": a, "end": b} for a, b in label_spans(t or "")] for t in text])


@F.pandas_udf(T.ArrayType(INT))
def find_pattern_udf(ids: pd.Series, pattern: pd.Series) -> pd.Series:
    return pd.Series([find_pattern(a, b) for a, b in zip(ids, pattern)])
