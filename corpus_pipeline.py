"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. A runner writes what a stage
returns as Parquet and hands the reread table to the next one; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import mixing, packing, quality, registry, simhash, spans
from quillon.llm.common import drop_scratch, materialize, read_table, scratch_scope

#: Scratch tables of the stages that ran before, by input folder and for each thread on its own: of no use once their result is stored.
_LEFT: ContextVar[dict[str, list[str]]] = ContextVar("left")


def tidy(stage):
    """A stage that first removes what earlier stages over the same tables left, unless its ``docs`` still read it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = dict(_LEFT.get({}))
        kept = drop_scratch(spark, left.get(sf_dir, []), docs)
        with scratch_scope() as made:
            out = stage(spark, docs, sf_dir)
        _LEFT.set(left | {sf_dir: [*kept, *made]})
        return out

    return run_stage


@tidy
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what fails the base rules or the isolation forest. A null text fails; without labels the forest rejects nothing."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts alike in 0.8 of their five-word shingles: SimHash finds them, the shingles tell.

    Of a group the row of the least doc_id stays, one with a null id only if none has one. Texts without words are one group.
    """
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


@tidy
def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut parts of sentences covered by a span that occurred before. A row that loses its last word goes; one without words stays."""
    return spans.remove_repeated_spans(docs)


@tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take rows, up to twice, to the target weights of domains, languages and sources. Null languages and sources are leaves of their own."""
    domain, weights = registry.mixture()
    return mixing.mixed_rows(docs, domain, weights)


@tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, piece by piece. A null or empty text is its end id alone."""
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeated spans", drop_repeated_spans),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: forest, fingerprints, automata and tokenizer are beyond it; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result stored before the next begins."""
    docs, stored = read_table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with scratch_scope() as made:
                docs = materialize(docs, f"pipeline-{k}")
            stored = [*drop_scratch(spark, stored, docs), *made]
    return docs
