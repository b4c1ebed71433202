"""From raw survey rows to annotation records: three precedences, merging by video, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.labels import yes_no
from quillon.functions.text import clean_text, ensure_sentence, evidence_key, range_tag, range_tags, time_tag_score

# Issue to question, name and dimension; the flag of an issue in a final evaluation.
ISSUES = {
    "human_distortion": ("qn1", "Human distortion issue", "Motion & Interaction"),
    "physics_violation": ("qn3", "Physics violation issue", "Motion & Interaction"),
    "product_consistency": ("qn4", "Product consistency issue", "Prompt Alignment"),
    "visual_text": ("qn5", "Visual text issue", "Video Quality"),
}
FLAGS = {
    "has_human_distortion_issue": "human_distortion",
    "has_physics_violation_issue": "physics_violation",
    "has_product_consistency_issue": "product_consistency",
}
DIMENSIONS = ("Video Quality", "Motion & Interaction", "Prompt Alignment")
EVAL = "struct<" + ",".join(f"{f}:string" for f in FLAGS) + ",evidence:string,time_ranges:array<struct<start:string,end:string>>>"
TEXTS = ("prompt_text", "video_url", "first_image_url", "image_path")


def final(question: str, part: str = "") -> Column:
    return F.col(f"`[Final]{question}{part}`").cast("string")


def evaluation(c: Column) -> Column:
    return F.from_json(c.cast("string"), EVAL)


def some(*texts: Column) -> Column:
    """The first text that isn't empty, else ''."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def video_ref(field: str = "auto") -> Column:
    path, url = clean_text(F.col("video_path")), clean_text(F.col("video_url"))
    return {"path": path, "url": url}.get(field, some(path, url))


def issue_of(ev: Column) -> Column:
    """The issue whose flag stands first in a final evaluation."""
    out = F.lit(None).cast("string")
    for flag, issue in reversed(FLAGS.items()):
        out = F.when(ev[flag].isNotNull(), issue).otherwise(out)
    return out


def annotation(issue: str) -> Column:
    """(decision, evidence, time_tag) over survey columns and ``_ev``, the parsed evaluation: a final evaluation of this very issue overrides the survey's columns."""
    question, flag = ISSUES[issue][0], next((f for f, i in FLAGS.items() if i == issue), None)
    ev = F.col("_ev")
    start, end = final(question, "_start_sec"), final(question, "_end_sec")
    decision, evidence, tag = yes_no(final(question)), clean_text(final(question, "_1")), F.coalesce(range_tag(start, end), F.lit(""))
    if flag:
        mine = F.coalesce(issue_of(ev) == issue, F.lit(False))
        decision = F.when(mine, F.coalesce(yes_no(ev[flag]), decision)).otherwise(decision)
        evidence = F.when(mine, some(clean_text(ev["evidence"]), evidence)).otherwise(evidence)
        tag = F.when(mine, range_tags(ev["time_ranges"], start, end)).otherwise(tag)
    return F.struct(decision.alias("decision"), evidence.alias("evidence"), tag.alias("time_tag"))


def fragment_of(name: Column, a: Column):
    """(evidence, fragment) of an affirmed issue."""
    evidence = some(a["evidence"], F.concat(F.lit("There is a "), F.lower(name), F.lit(".")))
    tag = F.when(a["time_tag"] != "", F.concat(a["time_tag"], F.lit(" "))).otherwise("")
    return evidence, F.trim(F.concat(name, F.lit(": "), tag, evidence))


def fragments(rows: DataFrame) -> DataFrame:
    """One row per issue that a survey row affirms: issue, evidence key, fragment, score."""
    parts = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(i).alias("issue"), F.lit(ISSUES[i][1]).alias("name"), annotation(i).alias("a")) for k, i in enumerate(ISSUES)])
    yes = rows.withColumn("_ev", evaluation(F.col("final_eval_result"))).withColumn("p", F.explode(parts)).where(F.col("p.a.decision") == "Yes").drop("_ev")
    evidence, fragment = fragment_of(F.col("p.name"), F.col("p.a"))
    out = yes.withColumn("fragment", fragment)
    key = some(evidence_key(evidence), evidence_key(F.col("fragment")))
    return out.withColumns({"rank": F.col("p.rank"), "issue": F.col("p.issue"), "evidence_key": key, "score": time_tag_score(F.col("fragment"))}).drop("p")


def best_fragments(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Of each (video, issue, evidence) the fragment of the greatest score, the first on ties, at the place of the first."""
    best = F.min_by("fragment", F.struct(-F.col("score"), F.col(order)))
    return rows.groupBy(by, "rank", "issue", "evidence_key").agg(F.min(order).alias("place"), best.alias("fragment")).drop("evidence_key")


def gpt_value(reasons: dict[str, Column]) -> Column:
    """Reasons by dimension to the tagged response: an issue makes its dimension a No."""
    line = lambda d: F.concat(F.lit(f"{d}: "), some(reasons[d], F.lit("Good.")))
    verdict = lambda d: F.concat(F.lit(f"{d}: "), F.when(reasons[d] != "", "No.").otherwise("Yes."))
    return F.concat(
        F.lit("<think>\n"), F.concat_ws("\n", *map(line, DIMENSIONS)), F.lit("\n</think>\n<answer>\n"), F.concat_ws(" ", *map(verdict, DIMENSIONS)), F.lit("\n</answer>"),
    )


def merge_videos(rows: DataFrame, order: str = "_seq", human: str = "<video>\n") -> DataFrame:
    """One record per video, in order of first appearance: texts, categories, files and the response.

    ``rows``: survey columns, ``category``, ``source_file`` and ``order``, the place in the scan. Rows without a video are left out.
    """
    keyed = rows.withColumn("video", video_ref()).where("video <> ''")
    first = lambda c: F.coalesce(F.min_by(clean_text(F.col(c)), F.when(clean_text(F.col(c)) != "", F.col(order))), F.lit(""))
    heads = keyed.groupBy("video").agg(
        F.min(order).alias("first_seq"), *[first(c).alias(c) for c in TEXTS],
        F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("source_file")).alias("source_files"),
    )
    best = best_fragments(fragments(keyed), "video", order)
    dim = F.create_map(*[F.lit(x) for i, v in ISSUES.items() for x in (i, v[2])])
    parts = best.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("rank", "place", "fragment", dim[F.col("issue")].alias("dim")))).alias("parts"))
    joined = heads.join(parts, "video", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<rank:int,place:bigint,fragment:string,dim:string>>")))
    def reason_of(dim_):
        return F.array_join(F.transform(F.filter("parts", lambda p: p["dim"] == dim_), lambda p: p["fragment"]), " ")

    reasons = {d: reason_of(d) for d in DIMENSIONS}
    return joined.withColumn("value", gpt_value(reasons)).select(
        "first_seq", F.array("video").alias("videos"),
        F.array(F.struct(F.lit("human").alias("from"), F.lit(human).alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("value").alias("value"))).alias("conversations"),
        F.struct(*TEXTS, "categories", "source_files").alias("metadata"),
    )


def rows_mode(rows: DataFrame, order: str = "_seq", human: str = "<video>\n") -> DataFrame:
    """A record per row with a video: what merging would make of that row alone. A projection; nothing is shuffled."""
    alone = rows.withColumn("_ref", video_ref()).where("_ref <> ''").withColumn("_ev", evaluation(F.col("final_eval_result")))
    alone = alone.withColumns({f"_{i}": annotation(i) for i in ISSUES})

    def reason_of(dim):
        told = [F.when(F.col(f"_{i}.decision") == "Yes", fragment_of(F.lit(name), F.col(f"_{i}"))[1]) for i, (_, name, d) in ISSUES.items() if d == dim]
        return F.concat_ws(" ", *told)

    value = gpt_value({d: reason_of(d) for d in DIMENSIONS})
    texts = [clean_text(F.col(c)).alias(c) for c in TEXTS]
    listed = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    return alone.select(
        F.col(order).alias("first_seq"), F.array("_ref").alias("videos"), conversation(F.lit(human), value),
        F.struct(*texts, listed("category").alias("categories"), listed("source_file").alias("source_files")).alias("metadata"),
    )


def conversation(human: Column, gpt: Column) -> Column:
    turn = lambda who, said: F.struct(F.lit(who).alias("from"), said.alias("value"))
    return F.array(turn("human", human), turn("gpt", gpt)).alias("conversations")


def single_issue_fallbacks(issue: str, negative: str) -> dict[str, Column]:
    """Decision, reason: final evaluation, then the survey's columns, then the nested payload, for each in turn."""
    question, name, _ = ISSUES[issue]
    flag = next(f for f, i in FLAGS.items() if i == issue)
    raw = F.coalesce(*[F.when(evaluation(F.col(c)).isNotNull() & (F.length(F.trim(F.col(c))) > 2), F.col(c)) for c in ("final_eval_result", "final_eval_result_raw")])
    ev = evaluation(raw)
    inside = lambda part: F.coalesce(F.get_json_object("Answer", f"$.dataMap.{question}{part}"), F.get_json_object("Answer", f"$.data.{question}{part}"))
    decision = F.coalesce(yes_no(ev[flag]), yes_no(final(question)), yes_no(inside("")))
    evidence = some(clean_text(ev["evidence"]), clean_text(final(question, "_1")), clean_text(inside("_1")))
    tag = some(
        range_tags(ev["time_ranges"]), F.coalesce(range_tag(final(question, "_start_sec"), final(question, "_end_sec")), F.lit("")),
        F.coalesce(range_tag(inside("_start_sec"), inside("_end_sec")), F.lit("")),
    )
    return {"decision": decision, "reason": reason(decision, evidence, tag, name, negative)}


def single_issue_survey_first(issue: str, negative: str) -> dict[str, Column]:
    """Decision prefers the final evaluation; evidence and time prefer the survey's columns."""
    question, name, _ = ISSUES[issue]
    flag = next(f for f, i in FLAGS.items() if i == issue)
    ev = evaluation(F.col("final_eval_result"))
    decision = F.coalesce(yes_no(ev[flag]), yes_no(final(question)))
    told = ev[flag].isNotNull()
    evidence = some(clean_text(final(question, "_1")), F.when(told, clean_text(ev["evidence"])))
    tag = some(F.coalesce(range_tag(final(question, "_start_sec"), final(question, "_end_sec")), F.lit("")), F.when(told, range_tags(ev["time_ranges"])))
    return {"decision": decision, "reason": reason(decision, evidence, tag, name, negative)}


def reason(decision: Column, evidence: Column, tag: Column, name: str, negative: str) -> Column:
    shown = some(evidence, F.lit(f"There is a {name.lower()}."))
    affirmed = F.concat(F.lit(f"{name}: "), F.when(tag != "", F.concat(tag, F.lit(" "))).otherwise(""), shown)
    return ensure_sentence(F.when(decision == "No", some(evidence, F.lit(negative))).otherwise(affirmed))


def single_issue_records(rows: DataFrame, parts: dict[str, Column], question: str, field: str = "auto", metadata: bool = False) -> DataFrame:
    """videos and conversations of the rows with a video and a decision, and on request where they come from."""
    built = rows.withColumns({"_video": video_ref(field), "_decision": parts["decision"], "_reason": parts["reason"]}).where("_video <> '' and _decision is not null")
    value = F.concat(F.lit("<think>\n"), F.col("_reason"), F.lit("\n</think>\n<answer>\n"), F.col("_decision"), F.lit("\n</answer>"))
    there = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    kept = F.struct(there("source_line").alias("source_line"), *[clean_text(there(c)).alias(c) for c in ("source_file", "video_path", *TEXTS)], there("video_duration_sec").alias("video_duration_sec"))
    return built.select(F.array("_video").alias("videos"), conversation(F.lit(question), value), *([kept.alias("metadata")] if metadata else []))


def category_counts(rows: DataFrame) -> DataFrame:
    """Rows of each category, and how many of them have no video."""
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(video_ref() == "").alias("skipped"))


def conversion_stats(rows: DataFrame, decision: Column, field: str = "auto") -> DataFrame:
    """Counts of a conversion; a row may be skipped for both reasons."""
    no_video, undecided = video_ref(field) == "", decision.isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_if(no_video).alias("without_video"), F.count_if(undecided).alias("undecided"),
        F.count_if(~no_video & ~undecided).alias("items"), F.count_if(~no_video & (decision == "Yes")).alias("yes"), F.count_if(~no_video & (decision == "No")).alias("no"),
    )


def answer_patterns(values: DataFrame, value: str) -> DataFrame:
    """How often each tuple of verdicts occurs, every mention in the text counted."""
    found = F.regexp_extract_all(value, F.lit(r"(?:Video Quality|Motion & Interaction|Prompt Alignment): (Yes|No)"), 1)
    return values.groupBy(F.array_join(found, "/").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
