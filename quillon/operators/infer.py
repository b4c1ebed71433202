"""Batch inference behind one interface: prompts in, texts out, errors beside them.

A model is a factory, called once per task, of a function from a list of requests to a list of texts. Rows that need
no model are filtered before it: a plan can't push a filter through Python. ``echo`` stands in for a model in tests.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.labels import answer_is_yes
from quillon.functions.text import remove_t_tags, replace_tag, time_spans
from quillon.operators.rewrite import claims, think_with_intervals

Model = Callable[[list[str]], list[str]]


def echo() -> Model:
    """Answers every request with its own words, each time the same."""
    return lambda requests: [f"echo: {r}" for r in requests]


def generate(df: DataFrame, request: str, output: str, model: Callable[[], Model], batch: int = 32, error: str = "error") -> DataFrame:
    """Adds the model's text and an error, one of which is null. A batch that fails is tried row by row."""
    columns = df.columns

    def run(frames):
        ask = model()

        def one(r):
            try:
                return ask([r])[0], None
            except Exception as e:  # noqa: BLE001  a row's failure is its result
                return None, f"{type(e).__name__}: {e}"

        for pdf in frames:
            texts, errors = [], []
            for k in range(0, len(pdf), batch):
                part = pdf[request].iloc[k : k + batch].tolist()
                try:
                    got = ask(part)
                    if len(got) != len(part):
                        raise ValueError("a text for each request is needed")
                    found = [(t, None) for t in got]
                except Exception:  # noqa: BLE001
                    found = [one(r) for r in part]
                texts += [t for t, _ in found]
                errors += [e for _, e in found]
            yield pdf[columns].assign(**{output: pd.Series(texts, index=pdf.index, dtype=object), error: pd.Series(errors, index=pdf.index, dtype=object)})

    schema = f"{df.schema.simpleString()[7:-1]},{output}:string,{error}:string"
    return df.mapInPandas(run, schema)


def generate_where(df: DataFrame, needs: Column, request: str, output: str, otherwise: Column, model: Callable[[], Model], **options) -> DataFrame:
    """The model for the rows that need it, an expression for the rest."""
    needed = generate(df.where(needs), request, output, model, **options)
    rest = df.where(~F.coalesce(needs, F.lit(False))).withColumns({output: otherwise.cast("string"), options.get("error", "error"): F.lit(None).cast("string")})
    return needed.unionByName(rest)


def tag_intervals(value: Column, intervals: Column, min_confidence: float = 0.0) -> Column:
    """A response whose claims carry the intervals a model gave."""
    from quillon.functions.text import first_tag

    return replace_tag(value, "think", think_with_intervals(claims(first_tag(value, "think", ignore_case=False)), intervals, min_confidence))


def pending_report(records: DataFrame, value: Column, has_file: Column) -> DataFrame:
    """How much there is to annotate: affirmed answers with time spans, their spans, and those without a file."""
    spans = F.size(time_spans(value))
    wanted = answer_is_yes(value) & (spans > 0)
    return records.agg(
        F.count_if(wanted & has_file).alias("pending_samples"), F.coalesce(F.sum(F.when(wanted & has_file, spans)), F.lit(0)).alias("pending_spans"),
        F.count_if(wanted & ~has_file).alias("missing_files"), F.count_if(F.contains(remove_t_tags(value), F.lit("<box>"))).alias("boxed"),
    )
