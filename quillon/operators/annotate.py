"""Annotation pipelines: boxes for time spans and nouns, intervals for claims, captions, over pluggable models.

Each explodes what has to be asked, asks every distinct request once, joins the answers back and writes them into the
texts. Stubs stand in for models; their answers are a function of the request.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scan
from quillon.functions.geometry import clamp_interval, frame_index
from quillon.functions.labels import all_answers_yes, answer_is_yes
from quillon.functions.text import (
    annotate_tags, first_tag, heuristic_object_prompt, insert_caption, let, loose_json, point_tags, replace_tag, should_skip_claim, strip, time_annotation,
    time_spans,
)
from quillon.operators.infer import Model, generate
from quillon.operators.rewrite import CLAIMS, claims, think_with_intervals

#: (video, frame, prompt) of each request to a box on a scale of 1000, or None.
Segmenter = Callable[[list[tuple[str, int, str]]], list[list[int] | None]]
#: (video, frame) of each request to the bytes of a picture, or None.
Decoder = Callable[[list[tuple[str, int]]], list[bytes | None]]


def stub_segmenter() -> Segmenter:
    """A box from frame and prompt; none for a frame whose number divides by 7."""
    return lambda asked: [None if frame % 7 == 0 else [frame % 100, len(prompt), frame % 100 + 50, len(prompt) + 50] for _, frame, prompt in asked]


def stub_decoder() -> Decoder:
    """The name and number of a frame in place of its picture; none for a negative number."""
    return lambda asked: [None if frame < 0 else f"{video}#{frame}".encode() for video, frame in asked]


def _ask(df: DataFrame, keys: list[str], output: str, kind: str, model: Callable, batch: int) -> DataFrame:
    """The distinct ``keys`` of ``df`` with the model's answer; an answer that fails is null."""

    def run(frames):
        ask = model()
        for pdf in frames:
            found = []
            for k in range(0, len(pdf), batch):
                part = list(pdf[keys].iloc[k : k + batch].itertuples(index=False, name=None))
                try:
                    found += ask(part)
                except Exception:  # noqa: BLE001  one by one, so that a failure is that of its request
                    for one in part:
                        try:
                            found += ask([one])
                        except Exception:  # noqa: BLE001
                            found.append(None)
            yield pdf[keys].assign(**{output: pd.Series(found, index=pdf.index, dtype=object)})

    distinct = df.select(*keys).distinct()
    return distinct.mapInPandas(run, f"{distinct.schema.simpleString()[7:-1]},{output}:{kind}")


def segment(requests: DataFrame, segmenter: Callable[[], Segmenter] = stub_segmenter, batch: int = 32) -> DataFrame:
    """``requests(video, frame, prompt)`` to their ``box``, one row for each distinct request."""
    return _ask(requests, ["video", "frame", "prompt"], "box", "array<int>", segmenter, batch)


def decode(requests: DataFrame, decoder: Callable[[], Decoder] = stub_decoder, batch: int = 32) -> DataFrame:
    """``requests(video, frame)`` to their ``picture``, one row for each distinct frame."""
    return _ask(requests, ["video", "frame"], "picture", "binary", decoder, batch)


# -- boxes for time spans ----------------------------------------------------------------------


def annotate_spans(
    records: DataFrame, key: str, value: str = "value", segmenter: Callable[[], Segmenter] = stub_segmenter, max_words: int = 6, partial: bool = False
) -> DataFrame:
    """Time spans of affirmed responses with a box at both ends, or with ``partial`` at one.

    ``records``: key, value, video, fps, frames. Adds changed, annotated_spans, skipped_spans. A video without frames
    has all its spans skipped, as has a span that names no object.
    """
    spans = time_spans(F.col(value))
    sound = (F.col("frames") > 0) & (F.col("fps") > 0)
    wanted = records.where(answer_is_yes(F.col(value)) & (F.size(spans) > 0))
    each = wanted.where(sound).select(key, "video", "fps", "frames", F.posexplode(spans).alias("k", "s"))
    each = each.select(
        key, "video", "k", "s.start_sec", "s.end_sec", heuristic_object_prompt(F.col("s.evidence"), max_words).alias("prompt"),
        frame_index(F.col("s.start_sec"), F.col("fps"), F.col("frames")).alias("a"), frame_index(F.col("s.end_sec"), F.col("fps"), F.col("frames")).alias("b"),
    )
    asked = each.where("prompt is not null").select("video", "prompt", F.explode(F.array("a", "b")).alias("frame"))
    boxes = segment(asked, segmenter)
    at = lambda side: boxes.select("video", "prompt", F.col("frame").alias(side), F.col("box").alias(f"box_{side}"))
    told = each.join(at("a"), ["video", "prompt", "a"], "left").join(at("b"), ["video", "prompt", "b"], "left")
    a, b = F.col("box_a").isNotNull(), F.col("box_b").isNotNull()
    note = F.when((a | b) if partial else (a & b), time_annotation(F.col("start_sec"), F.col("end_sec"), F.col("box_a"), F.col("box_b")))
    notes = told.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", note.alias("note")))), lambda n: n["note"]).alias("_notes"))
    out = records.join(notes, key, "left")
    done = F.size(F.filter("_notes", lambda n: n.isNotNull()))
    n = F.when(answer_is_yes(F.col(value)), F.size(spans)).otherwise(0)
    done = F.coalesce(F.when(F.col("_notes").isNotNull(), done), F.lit(0))
    return out.withColumns(
        {"annotated_spans": done, "skipped_spans": n - done, "changed": done > 0, value: F.when(done > 0, annotate_tags(F.col(value), F.col("_notes"))).otherwise(F.col(value))}
    ).drop("_notes")


# -- boxes for nouns ---------------------------------------------------------------------------


def annotate_nouns(records: DataFrame, key: str, value: str = "value", segmenter: Callable[[], Segmenter] = stub_segmenter) -> DataFrame:
    """Nouns of the thinking with time and box behind them, in the response that holds the thinking.

    ``records``: key, value, thinking, nouns, video, fps, frames. Range tags become points everywhere; that is all where
    every answer is yes, no noun has a range before it or the video has no frames.
    """
    plain = point_tags(F.col(value))
    wanted = records.where(~F.coalesce(all_answers_yes(plain), F.lit(False)) & (F.col("frames") > 0) & (F.col("fps") > 0))
    found = wanted.select(key, "video", "fps", "frames", F.posexplode(scan.noun_mentions_udf("thinking", "nouns")).alias("k", "m"))
    found = found.select(key, "video", "k", "m.noun", "m.start_sec", frame_index(F.col("m.start_sec"), F.col("fps"), F.col("frames")).alias("frame"))
    boxes = segment(found.select("video", "frame", F.col("noun").alias("prompt")), segmenter).withColumnRenamed("prompt", "noun")
    placed = found.join(boxes, ["video", "frame", "noun"], "left")
    marks = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "noun", "start_sec", "box"))).alias("_marks"))
    out = records.join(marks, key, "left").withColumn("_think", point_tags(F.col("thinking")))
    mentions = F.transform("_marks", lambda m: F.struct(m["noun"].alias("noun"), m["start_sec"].alias("start_sec"), m["box"].alias("box")))
    out = out.withColumn("_boxed", F.when(F.col("_marks").isNotNull(), scan.place_boxes_udf("_think", mentions)))
    at = F.position(F.col("_think"), plain)
    new = F.concat(plain.substr(F.lit(1), at - 1), F.col("_boxed"), plain.substr(at + F.length("_think"), F.length(plain)))
    return out.withColumn(value, F.when(F.col("_boxed").isNotNull() & (at > 0), new).otherwise(plain)).drop("_marks", "_think", "_boxed")


# -- intervals for claims ----------------------------------------------------------------------


def tag_claims(
    records: DataFrame, key: str, model: Callable[[], Model], human: str = "human", value: str = "value", prompt: str = "{claim}", min_confidence: float = 0.0
) -> DataFrame:
    """Claims with a fault get the interval that a model gives for them; what failed is told in ``error`` and the record stays as it was.

    ``records``: key, human, value, has_file, duration. A model answers with JSON (start_sec, end_sec, confidence), read
    out of other text if need be; an answer that can't be read leaves its claim bare. Doubled stops in the human turn
    become single ones.
    """
    think = first_tag(F.col(value), "think", ignore_case=False)
    said = let(claims(think)["Visual Quality"], lambda v: F.array(v, *[claims(think)[c] for c in CLAIMS[1:]]))
    error = (
        F.when(think == "", "no think block").when(F.forall(said, lambda c: strip(c) == ""), "no claims in the think block")
        .when(~F.coalesce(F.col("has_file"), F.lit(False)), "video not found").when(F.col("duration").isNull() | (F.col("duration") <= 0), "no frames")
    )
    marked = records.withColumns({"_said": said, "error": error})
    each = marked.where("error is null").select(key, "duration", F.posexplode("_said").alias("k", "claim"))
    each = each.where((strip(F.col("claim")) != "") & ~should_skip_claim(F.col("claim")))
    each = generate(each.withColumn("_request", F.replace(F.lit(prompt), F.lit("{claim}"), F.col("claim"))), "_request", "_text", model, error="_failed")
    number = lambda f: F.get_json_object(loose_json(F.col("_text")), f"$.{f}").try_cast("double")
    start, end = clamp_interval(number("start_sec"), number("end_sec"), F.col("duration").cast("double"))
    bad = F.col("_failed").isNotNull() | number("start_sec").isNull() | number("end_sec").isNull()
    interval = F.struct(start.alias("start_sec"), end.alias("end_sec"), F.coalesce(number("confidence"), F.lit(0.0)).alias("confidence"), bad.alias("error"))
    given = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", interval))).alias("_given"))
    out = marked.join(given, key, "left")
    intervals = F.transform(F.sequence(F.lit(0), F.lit(len(CLAIMS) - 1)), lambda k: F.element_at("_given", k))
    new = replace_tag(F.col(value), "think", think_with_intervals(claims(think), intervals, min_confidence))
    sound = F.col("error").isNull()
    return out.withColumns({value: F.when(sound, new).otherwise(F.col(value)), human: F.when(sound, F.replace(F.col(human), F.lit(".."), F.lit("."))).otherwise(F.col(human))}).drop("_said", "_given")


# -- captions ----------------------------------------------------------------------------------


def apply_captions(records: DataFrame, captions: DataFrame, index: str, value: str = "value", prefix: str = "Video Caption: ") -> DataFrame:
    """Each record that has a caption gets it at the head of its think block; ``captions(index, caption)`` has one row an index."""
    out = records.join(captions.select(index, F.col("caption").alias("_caption")), index, "left")
    return out.withColumn(value, F.when(F.col("_caption").isNotNull(), insert_caption(F.col(value), F.col("_caption"), prefix)).otherwise(F.col(value))).drop("_caption")
