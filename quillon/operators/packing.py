"""Records into packs of a token budget, block by block."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import word_count

FIXED_TOKENS = 21


def token_estimate(conversations: Column, visual: Column, per_turn: int = 5) -> Column:
    """A fixed head, the words of each turn with its frame, and visual tokens. A tokenizer's counts may take its place."""
    turns = F.transform(conversations, lambda t: word_count(F.coalesce(t["value"], F.lit(""))) + per_turn)
    return F.aggregate(turns, F.lit(FIXED_TOKENS), lambda a, n: a + n) + F.coalesce(visual, F.lit(0))


def fit_descending(sizes: list[int], capacity: int) -> list[int]:
    """Pack number of each item: largest first, each into the fullest pack with room; an oversize item has one to itself."""
    room: list[int] = []
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [p for p, r in enumerate(room) if r >= sizes[k]]
        if fits:
            at = min(fits, key=lambda p: (room[p], p))
        else:
            room.append(capacity)
            at = len(room) - 1
        room[at] -= sizes[k]
        out[k] = at
    return out


def pack_blocks(df: DataFrame, index: str, tokens: str, capacity: int = 4096, block: int = 256) -> DataFrame:
    """(block, pack, index, tokens): consecutive rows in blocks, each packed on its own; a block is one small group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        return pdf.assign(pack=fit_descending(pdf[tokens].tolist(), capacity))[["block", "pack", index, tokens]]

    rows = df.select(F.floor(F.col(index) / block).cast("long").alias("block"), F.col(index).cast("long").alias(index), F.col(tokens).cast("long").alias(tokens))
    return rows.groupBy("block").applyInPandas(run, f"block long, pack long, {index} long, {tokens} long")
