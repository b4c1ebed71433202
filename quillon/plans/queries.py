"""One query per operator family over the test tables, each with the SQL that says the same.

The tables hold no tagged text, so queries render it first: the RENDER expressions are plain SQL that both
engines read alike. ``QUERIES`` maps a name to (spark, sf_dir) -> DataFrame, ``SQL`` to DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import arrays, geometry, labels, text
from quillon.operators import curate, infer, joins, metrics, packing, records, rewrite, split

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- rendered inputs ---------------------------------------------------------------------------

YN = lambda test: f"CASE WHEN {test} THEN 'Yes' ELSE 'No' END"
TRUTH = (
    f"concat('<answer>Video Quality: ', {YN('quality = 1')}, '. Motion & Interaction: ', {YN('toxic = 0')}, "
    f"'. Prompt Alignment: ', {YN('doc_id % 3 <> 0')}, '.</answer>')"
)
SAID = (
    f"concat('<think>seen</think>', CASE WHEN doc_id % 11 = 0 THEN '' ELSE '<answer>' END, '[Visual Quality]: ', "
    f"CASE WHEN doc_id % 7 = 0 THEN 'Maybe' WHEN doc_id % 5 = 0 THEN 'Bad' ELSE 'Good' END, '. Motion and Interaction: ', "
    f"{YN('doc_id % 4 <> 0')}, '. Prompt Alignment: ', {YN('doc_id % 6 <> 0')}, '.')"
)
SEVEN = (
    "concat('<answer>Video Quality: ', " + YN("quality = 1") + ", '. Subject Movement: ', " + YN("doc_id % 2 = 0") + ", '. Physical Interaction: ', "
    + YN("doc_id % 3 = 0") + ", '. Cause-Effect: ', " + YN("doc_id % 5 <> 0") + ", '. Subject Existence: Yes. Object Existence: ', " + YN("toxic = 0")
    + ", '. Subject-Object Interaction: ', CASE WHEN doc_id % 13 = 0 THEN 'Unsure' ELSE 'Yes' END, '.</answer>')"
)
SINGLE_SAID = "CASE WHEN doc_id % 5 = 0 THEN 'Yes, because no' WHEN doc_id % 5 = 1 THEN '<answer>Yes.</answer>' WHEN doc_id % 5 = 2 THEN 'The answer is no.' WHEN doc_id % 5 = 3 THEN '<answer> NO ' ELSE 'none' END"
SINGLE_TRUE = f"concat('<answer>', {YN('quality = 1')}, '</answer>')"
SPANS = (
    "concat('<think>Physics violation issue: <t>', CAST(event_id % 9 AS VARCHAR(9)), 's-', CAST(event_id % 7 + 3 AS VARCHAR(9)), '.5s</t> The ball floats. ', "
    "CASE WHEN event_id % 3 = 0 THEN '<t>1s-2s</t> It  falls down.' ELSE 'Rest.' END, '</think>\n<answer>', " + YN("event_id % 4 <> 0") + ", '</answer>')"
)


def rendered(spark, sf_dir, name, keep="", **exprs):
    kept = [k for k in keep.split() if k]
    return table(spark, sf_dir, name).selectExpr(*kept, *[f"{e} AS {k}" for k, e in exprs.items()])


def _confusion_sql(dims: str, rows: str) -> str:
    """SQL of the confusion table over rows(dim, pred, gt)."""
    return f"""
WITH {rows},
counts AS (
  SELECT COALESCE(dim, 'overall') AS dim, count(*) FILTER (WHERE gt IN ('yes','no')) AS total,
    count(*) FILTER (WHERE gt = 'yes') AS gt_yes, count(*) FILTER (WHERE gt = 'no') AS gt_no,
    count(*) FILTER (WHERE gt IN ('yes','no') AND pred = gt) AS correct,
    count(*) FILTER (WHERE gt = 'yes' AND pred = 'yes') AS tp, count(*) FILTER (WHERE gt = 'no' AND pred = 'no') AS tn,
    count(*) FILTER (WHERE gt = 'no' AND pred = 'yes') AS fp, count(*) FILTER (WHERE gt = 'yes' AND pred = 'no') AS fn,
    count(*) FILTER (WHERE gt IN ('yes','no') AND pred = 'fail') AS fail_pred
  FROM parsed GROUP BY ROLLUP (dim)
),
rates AS (
  SELECT *, CASE WHEN total = 0 THEN 0.0 ELSE CAST(correct AS DOUBLE) / total END AS accuracy,
    CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS "precision",
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall
  FROM counts
)
SELECT dim, total, gt_yes, gt_no, correct, tp, tn, fp, fn, fail_pred, round(CAST(accuracy AS DOUBLE), 6) AS accuracy,
  round(CAST("precision" AS DOUBLE), 6) AS "precision", round(CAST(recall AS DOUBLE), 6) AS recall,
  round(CAST(CASE WHEN "precision" + recall = 0 THEN 0.0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS DOUBLE), 6) AS f1
FROM rates"""


def _round_rates(df):
    return df.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


_WORD = r"regexp_replace(lower(trim({0})), '[^a-z0-9_]', '', 'g')"
_LABEL = "CASE WHEN {w} IN ('yes','y','true','1','good') THEN 'yes' WHEN {w} IN ('no','n','false','0','bad') THEN 'no' ELSE 'fail' END"


def _key_sql(col: str, names: str) -> str:
    hit = rf"regexp_extract({col}, '\[?\s*(?:{names})\s*\]?\s*[:：]\s*([A-Za-z]+)', 1, 'i')"
    return _LABEL.format(w=_WORD.format(hit))


_MERGED_NAMES = {
    "Video Quality": "Video Quality|Visual Quality",
    "Motion & Interaction": "Motion & Interaction|Motion and Interaction|Motion & Physical Consistency|Motion and Physical Consistency",
    "Prompt Alignment": "Prompt Alignment",
}


def _body(col: str) -> str:
    return rf"CASE WHEN regexp_matches({col}, '<answer>', 'i') THEN trim(regexp_extract({col}, '<answer>\s*(.*?)\s*(?:</answer>|$)', 1, 'is')) ELSE trim({col}) END"


# -- evaluation ----------------------------------------------------------------------------------


@query(
    _confusion_sql(
        "",
        f"src AS (SELECT {_body('answer')} AS p, {_body('ground_truth')} AS g FROM (SELECT {SAID} AS answer, {TRUTH} AS ground_truth FROM labels)),\nparsed AS ("
        + " UNION ALL ".join(f"SELECT '{d}' AS dim, {_key_sql('p', n)} AS pred, {_key_sql('g', n)} AS gt FROM src" for d, n in _MERGED_NAMES.items())
        + ")",
    )
)
def eval_merged_metrics(spark, sf_dir):
    return _round_rates(metrics.confusion(rendered(spark, sf_dir, "labels", answer=SAID, ground_truth=TRUTH), "merged"))


_SINGLE = (
    "CASE WHEN {l} <> 'fail' THEN {l} WHEN len(regexp_extract_all({c}, '\\b(yes|no)\\b', 1, 'i')) = 1 "
    "THEN lower(regexp_extract({c}, '\\b(yes|no)\\b', 1, 'i')) ELSE 'fail' END"
)


@query(
    _confusion_sql(
        "",
        f"src AS (SELECT {_body('answer')} AS p, {_body('ground_truth')} AS g FROM (SELECT {SINGLE_SAID} AS answer, {SINGLE_TRUE} AS ground_truth FROM labels)),\n"
        f"parsed AS (SELECT 'Answer' AS dim, {_SINGLE.format(l=_LABEL.format(w=_WORD.format('p')), c='p')} AS pred, {_LABEL.format(w=_WORD.format('g'))} AS gt FROM src)",
    )
)
def eval_single_issue_metrics(spark, sf_dir):
    return _round_rates(metrics.confusion(rendered(spark, sf_dir, "labels", answer=SINGLE_SAID, ground_truth=SINGLE_TRUE), "single_issue"))


@query(
    _confusion_sql(
        "",
        f"src AS (SELECT {_body('t')} AS g FROM (SELECT {SEVEN} AS t FROM labels)),\nparsed AS ("
        + " UNION ALL ".join(f"SELECT '{d}' AS dim, {_key_sql('g', d)} AS pred, {_key_sql('g', d)} AS gt FROM src" for d in labels.LEGACY)
        + ")",
    )
)
def eval_legacy_metrics(spark, sf_dir):
    return _round_rates(metrics.confusion(rendered(spark, sf_dir, "labels", answer=SEVEN, ground_truth=SEVEN), "legacy"))


def _merge3(keys):
    x = [_key_sql("g", k) for k in keys]
    return f"CASE WHEN {' AND '.join(f'{v} = $$yes$$' for v in x)} THEN 'yes' WHEN {' OR '.join(f'{v} = $$no$$' for v in x)} THEN 'no' ELSE 'fail' END"


@query(
    f"WITH src AS (SELECT doc_id, {_body('t')} AS g FROM (SELECT doc_id, {SEVEN} AS t FROM labels)) SELECT doc_id, {_key_sql('g', 'Video Quality')} AS video_quality, "
    f"{_merge3(labels.GROUPS['Motion & Interaction'])} AS motion, {_merge3(labels.GROUPS['Prompt Alignment'])} AS prompt FROM src"
)
def eval_legacy_fallback(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", t=SEVEN)
    found = labels.parse_verdicts(F.col("t"), "merged")
    return rows.select("doc_id", *[found[d].alias(n) for d, n in zip(labels.MERGED, ("video_quality", "motion", "prompt"))])


_JUDGE = "concat('ok **Consistency Score:** ', CASE WHEN doc_id % 7 = 0 THEN '1.5x' WHEN doc_id % 7 = 1 THEN 'none' ELSE concat('0.', CAST(doc_id % 90 + 10 AS VARCHAR(9))) END)"


@query(
    rf"""
WITH s AS (SELECT TRY_CAST(regexp_extract(j, 'Consistency\s*Score\s*[:：]?\s*\**\s*([01](?:\.\d+)?)', 1, 'i') AS DOUBLE) AS x FROM (SELECT {_JUDGE} AS j FROM labels))
SELECT round(avg(x) FILTER (WHERE x BETWEEN 0 AND 1), 9) AS mean_score, count(*) FILTER (WHERE x BETWEEN 0 AND 1) AS n_scores FROM s"""
)
def consistency_score_mean(spark, sf_dir):
    found = metrics.mean_consistency(rendered(spark, sf_dir, "labels", judgment=_JUDGE))
    return found.withColumn("mean_score", F.round("mean_score", 9))


@query(
    f"SELECT doc_id, CASE WHEN w IN ('yes','good','true','correct','present','exists','aligned','match','matched','plausible') THEN 'yes' "
    f"WHEN w IN ('no','bad','false','incorrect','absent','missing','misaligned','mismatch','implausible') THEN 'no' WHEN w = '' THEN 'fail' ELSE w END AS label "
    f"FROM (SELECT doc_id, regexp_extract(rtrim(lower(trim(t)), '.'), '^([^\\s,;:]*)', 1) AS w FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Mismatch, because' WHEN 1 THEN 'Good alignment' WHEN 2 THEN ' Yes. ' WHEN 3 THEN '' ELSE 'Perhaps so' END AS t FROM labels))"
)
def trainer_labels(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", t="CASE doc_id % 5 WHEN 0 THEN 'Mismatch, because' WHEN 1 THEN 'Good alignment' WHEN 2 THEN ' Yes. ' WHEN 3 THEN '' ELSE 'Perhaps so' END")
    return rows.select("doc_id", labels.trainer_label(F.col("t")).alias("label"))


_MODEL = "concat('/models/', CASE doc_id % 8 WHEN 0 THEN 'InternVL3' WHEN 1 THEN 'Molmo2-4B' WHEN 2 THEN 'gemma-3' WHEN 3 THEN 'MiniCPM-V' WHEN 4 THEN 'Qwen2.5-VL' WHEN 5 THEN 'Qwen2-VL' WHEN 6 THEN 'qwen2_5' ELSE 'other' END)"


@query(
    f"SELECT doc_id, CASE WHEN m LIKE '%internvl%' THEN 'internvl' WHEN m LIKE '%molmo%' THEN 'molmo2' WHEN m LIKE '%gemma%' THEN 'gemma4' WHEN m LIKE '%minicpm%' THEN 'minicpmv' "
    f"WHEN contains(m, 'qwen2.5') OR contains(m, 'qwen2_5') THEN 'qwen2.5vl' WHEN m LIKE '%qwen2%' THEN 'qwen2vl' ELSE 'qwen3vl' END AS family FROM (SELECT doc_id, lower({_MODEL}) AS m FROM labels)"
)
def model_families(spark, sf_dir):
    return rendered(spark, sf_dir, "labels", "doc_id", m=_MODEL).select("doc_id", labels.model_family(F.col("m")).alias("family"))


# -- conversations ------------------------------------------------------------------------------


@query(
    "SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || ':' || md5(COALESCE(text, '')), ',' ORDER BY turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, text) AS digest FROM conversations GROUP BY conv_id"
)
def conversation_nest(spark, sf_dir):
    nested = records.nest(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    digest = F.transform("conversations", lambda t: F.concat(t["from"], F.lit(":"), F.md5(F.coalesce(t["value"], F.lit("")).cast("binary"))))
    return nested.select("conv_id", F.size("conversations").cast("long").alias("n_turns"), F.array_join(digest, ",").alias("digest"))


@query(
    "WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, text) - 1 AS k FROM conversations) "
    "SELECT conv_id, CAST(k AS INTEGER) AS turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM o"
)
def conversation_unnest(spark, sf_dir):
    return records.unnest(records.nest(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"), "conv_id")


@query(
    r"WITH w AS (SELECT conv_id, len(list_filter(string_split_regex(COALESCE(text, ''), '[\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+'), lambda x: x <> '')) AS n FROM conversations) "
    "SELECT conv_id, CAST(sum(n) + 128 AS BIGINT) AS with_image, CAST(-sum(n) AS BIGINT) AS without_media FROM w GROUP BY conv_id"
)
def conversation_word_lengths(spark, sf_dir):
    nested = records.nest(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    a, _ = records.word_lengths(F.col("conversations"), F.lit("x"), F.lit(None))
    _, b = records.word_lengths(F.col("conversations"), F.lit(None), F.lit(None))
    return nested.select("conv_id", a.cast("long").alias("with_image"), b.cast("long").alias("without_media"))


@query("WITH l AS (SELECT conv_id, arg_max(CASE WHEN conv_id % 4 = 0 THEN concat(text, ' Nullify') ELSE text END, turn) AS v FROM conversations GROUP BY conv_id) SELECT conv_id FROM l WHERE NOT COALESCE(contains(lower(v), 'null'), FALSE)")
def null_substring_filter(spark, sf_dir):
    turns = rendered(spark, sf_dir, "conversations", "conv_id turn role", text="CASE WHEN conv_id % 4 = 0 THEN concat(text, ' Nullify') ELSE text END")
    return records.drop_nullish(records.nest(turns, "conv_id", "turn", "role", "text")).select("conv_id")


_HUMAN = "concat(CASE WHEN doc_id % 4 = 0 THEN '<image>' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN '<video>' ELSE '' END, '\nIs it so? ', CASE WHEN doc_id % 9 = 0 THEN '<image>' ELSE '' END)"
_GPT = "CASE WHEN doc_id % 10 = 0 THEN 'see <video>' ELSE '<think>why</think>yes' END"


def _dialogue(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", h=_HUMAN, g=_GPT)
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    pool = lambda kind, test: F.when(test, F.array(F.concat(F.lit(f"{kind}/"), F.col("doc_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"conversations": F.array(turn("human", "h"), turn("gpt", "g")), "images": pool("i", F.col("doc_id") % 4 == 0), "videos": pool("v", F.col("doc_id") % 3 == 0)})


@query(
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS i, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS v, CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS x, doc_id % 10 = 0 AS told FROM labels) "
    "SELECT doc_id, concat_ws(',', CASE WHEN x = 1 THEN concat('token_mismatch:image:', i, ':', i + x) END, CASE WHEN told THEN 'gpt_media_token:::' END) AS problems FROM d"
)
def validator_problems(spark, sf_dir):
    rows = _dialogue(spark, sf_dir)
    found = records.problems(F.col("conversations"), F.col("images"), F.col("videos"))
    line = F.transform(found, lambda p: F.concat(p["type"], F.lit(":"), F.coalesce(p["media_type"], F.lit("")), F.lit(":"), F.coalesce(p["expected"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(p["actual"].cast("string"), F.lit(""))))
    return rows.select("doc_id", F.array_join(line, ",").alias("problems"))


@query(
    "SELECT count(*) AS total_entries, count(*) FILTER (WHERE doc_id % 9 <> 0 AND doc_id % 10 <> 0) AS valid_entries, CAST(0 AS BIGINT) AS missing_media, count(*) FILTER (WHERE doc_id % 9 = 0) AS token_mismatches, "
    "count(*) FILTER (WHERE doc_id % 10 = 0) AS gpt_media_tokens, count(*) FILTER (WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0) AS image_only, count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0) AS video_only, count(*) FILTER (WHERE doc_id % 12 = 0) AS mixed FROM labels"
)
def validator_stats(spark, sf_dir):
    rows = _dialogue(spark, sf_dir).withColumn("problems", records.problems(F.col("conversations"), F.col("images"), F.col("videos")))
    return records.validation_stats(rows)


@query(
    "SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 4 = 0 THEN concat('image=/m/i/', doc_id) END, CASE WHEN doc_id % 3 = 0 THEN concat('video=/m/v/', doc_id) END, concat('text=Watch.\n', 'Is it so?'), "
    "CASE WHEN doc_id % 9 = 0 THEN 'image=' END) AS parts, CASE WHEN doc_id % 10 = 0 THEN 'see <video>' ELSE 'yes' END AS reply, CASE WHEN doc_id % 9 = 0 THEN 'more <image> placeholders than files' END AS error FROM labels"
)
def message_builder(spark, sf_dir):
    built, error = records.messages(F.col("conversations"), F.col("images"), F.col("videos"), F.lit("/m"), cot=False, time_instruction=F.lit("Watch."))
    part = lambda p: F.concat(p["type"], F.lit("="), F.coalesce(p["text"], p["image"], p["video"], F.lit("")))
    rows = _dialogue(spark, sf_dir).select("doc_id", built.alias("m"), error.alias("error"))
    return rows.select("doc_id", F.array_join(F.transform(F.col("m")[0]["content"], part), "|").alias("parts"), F.col("m")[1]["content"][0]["text"].alias("reply"), "error")


@query(
    "SELECT doc_id, concat_ws('\n', CASE WHEN doc_id % 4 = 0 THEN '<image>./</image>' END, CASE WHEN doc_id % 3 = 0 THEN 'Frame1: <image>./</image>\nFrame2: <image>./</image>\nFrame3: <image>./</image>' END, 'Is it so?', CASE WHEN doc_id % 9 = 0 THEN '<image>./</image>' END) AS content, "
    "concat_ws(';', CASE WHEN doc_id % 4 = 0 THEN '-1' END, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN '1,2;3' ELSE '0,1;2' END END, CASE WHEN doc_id % 9 = 0 THEN '-1' END) AS frames FROM labels"
)
def frame_message_builder(spark, sf_dir):
    built, groups = records.frame_messages(F.col("conversations"), F.array(F.lit(3)), 2)
    rows = _dialogue(spark, sf_dir).select("doc_id", built.alias("m"), groups.alias("g"))
    return rows.select("doc_id", F.col("m")[0]["content"].alias("content"), F.array_join(F.transform("g", lambda g: F.array_join(g.cast("array<string>"), ",")), ";").alias("frames"))


@query(
    "SELECT doc_id, concat('text=Is it so?', CASE WHEN doc_id % 4 = 0 THEN concat('|image=/m/i/', doc_id) ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN concat('|video=/m/v/', doc_id) ELSE '' END, CASE WHEN doc_id % 9 = 0 THEN '|image=' ELSE '' END) AS parts, "
    "CASE WHEN doc_id % 3 = 0 THEN concat('/m/v/', doc_id) END AS video, concat('Is it so?\n', CASE WHEN doc_id % 10 = 0 THEN 'see <video>' ELSE '<think>why</think>yes' END) AS said, CASE WHEN doc_id % 3 = 0 THEN concat('Is it so?@/m/v/', doc_id) END AS request FROM labels"
)
def message_projections(spark, sf_dir):
    built, _ = records.messages(F.col("conversations"), F.col("images"), F.col("videos"), F.lit("/m"))
    part = lambda p: F.concat(p["type"], F.lit("="), F.coalesce(p["text"], p["image"], p["video"], F.lit("")))
    rows = _dialogue(spark, sf_dir).select("doc_id", built.alias("m"))
    ask = records.request(F.col("m"))
    return rows.select(
        "doc_id", F.array_join(F.transform(records.text_first(F.col("m")[0]["content"], F.col("m")[0]["role"]), part), "|").alias("parts"),
        records.first_video(F.col("m")).alias("video"), records.all_text(F.col("m")).alias("said"), F.concat(ask["prompt"], F.lit("@"), ask["video"]).alias("request"),
    )


# -- curation -----------------------------------------------------------------------------------

_SURVEY = {
    "video_path": "CASE WHEN event_id % 17 = 0 THEN ' ' ELSE concat('v/', CAST(user_id AS VARCHAR(20)), '.mp4') END",
    "video_url": "CASE WHEN event_id % 34 = 0 THEN '' ELSE concat('http://h/', CAST(user_id AS VARCHAR(20))) END",
    "prompt_text": "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(' ask  ', CAST(event_id AS VARCHAR(20))) END",
    "first_image_url": "''", "image_path": "CAST(NULL AS VARCHAR(9))", "category": "event_type", "source_file": "concat('f', CAST(event_id % 4 AS VARCHAR(9)))",
    "qn1": "CASE WHEN event_id % 5 = 0 THEN ' YES ' ELSE 'no' END", "qn1_1": "concat('Bent ', event_type, '  hand!')",
    "qn1_s": "CAST(event_id % 10 AS VARCHAR(9))", "qn1_e": "CAST(event_id % 10 + event_id % 3 AS VARCHAR(9))",
    "qn3": "CASE WHEN event_id % 7 = 0 THEN 'yes' ELSE NULL END",
}


def _survey(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id user_id", **_SURVEY)
    rename = {"qn1": "[Final]qn1", "qn1_1": "[Final]qn1_1", "qn1_s": "[Final]qn1_start_sec", "qn1_e": "[Final]qn1_end_sec", "qn3": "[Final]qn3"}
    rows = rows.withColumnsRenamed(rename)
    missing = [f"[Final]{q}{p}" for q in ("qn1", "qn3", "qn4", "qn5") for p in ("", "_1", "_start_sec", "_end_sec") if f"[Final]{q}{p}" not in rows.columns]
    blank = F.lit(None).cast("string")
    ev = F.when(F.col("event_id") % 6 == 0, F.lit('{"has_physics_violation_issue": "Yes", "evidence": "It floats", "time_ranges": [{"start": 1, "end": "2.5"}]}'))
    return rows.withColumns({**{m: blank for m in missing}, "final_eval_result": ev, "final_eval_result_raw": blank, "Answer": blank}).withColumnRenamed("event_id", "_seq")


_FRAG_SQL = (
    "WITH s AS (SELECT event_id AS seq, " + ", ".join(f"{e} AS {k}" for k, e in _SURVEY.items()) + " FROM events),\n"
    "k AS (SELECT *, COALESCE(nullif(trim(video_path), ''), nullif(trim(video_url), '')) AS video FROM s),\n"
    "keyed AS (SELECT * FROM k WHERE video IS NOT NULL),\n"
    "frag AS (\n"
    "  SELECT video, 0 AS rank, seq, lower('bent ' || category || ' hand') AS ek, (seq % 3) * 1.0 AS score,\n"
    "    'Human distortion issue: <t>' || qn1_s || 's-' || qn1_e || 's</t> Bent ' || category || ' hand!' AS fragment FROM keyed WHERE lower(trim(qn1)) = 'yes'\n"
    "  UNION ALL\n"
    "  SELECT video, 1, seq, CASE WHEN seq % 6 = 0 THEN 'it floats' ELSE 'there is a physics violation issue' END, CASE WHEN seq % 6 = 0 THEN 1.5 ELSE 0.0 END,\n"
    "    CASE WHEN seq % 6 = 0 THEN 'Physics violation issue: <t>1s-2.5s</t> It floats' ELSE 'Physics violation issue: There is a physics violation issue.' END\n"
    "  FROM keyed WHERE seq % 6 = 0 OR seq % 7 = 0\n"
    "),\n"
    "best AS (SELECT *, min(seq) OVER (PARTITION BY video, rank, ek) AS place, row_number() OVER (PARTITION BY video, rank, ek ORDER BY score DESC, seq) AS rn FROM frag),\n"
    "reasons AS (SELECT video, string_agg(fragment, ' ' ORDER BY rank, place, fragment) AS reason FROM best WHERE rn = 1 GROUP BY video)\n"
)


@query(_FRAG_SQL + "SELECT video, CAST(rank AS INTEGER) AS rank, place, fragment FROM best WHERE rn = 1")
def curate_best_fragments(spark, sf_dir):
    keyed = _survey(spark, sf_dir).withColumn("video", curate.video_ref()).where("video <> ''")
    return curate.best_fragments(curate.fragments(keyed), "video", "_seq").select("video", "rank", "place", "fragment")


@query(
    _FRAG_SQL
    + """SELECT k.video, min(seq) AS first_seq, COALESCE(arg_min('ask ' || seq, seq) FILTER (WHERE seq % 3 <> 0), '') AS prompt_text, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
  string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS files,
  '<think>
Video Quality: Good.
Motion & Interaction: ' || COALESCE(any_value(reason), 'Good.') || '
Prompt Alignment: Good.
</think>
<answer>
Video Quality: Yes. Motion & Interaction: ' || CASE WHEN any_value(reason) IS NULL THEN 'Yes' ELSE 'No' END || '. Prompt Alignment: Yes.
</answer>' AS value
FROM keyed k LEFT JOIN reasons r ON k.video = r.video GROUP BY k.video"""
)
def curate_unique_merge(spark, sf_dir):
    merged = curate.merge_videos(_survey(spark, sf_dir))
    return merged.select(
        F.col("videos")[0].alias("video"), "first_seq", "metadata.prompt_text", F.array_join("metadata.categories", ",").alias("categories"),
        F.array_join("metadata.source_files", ",").alias("files"), F.col("conversations")[1]["value"].alias("value"),
    )


_ROW_PATTERN = "CASE WHEN seq % 5 = 0 OR seq % 6 = 0 OR seq % 7 = 0 THEN 'Yes/No/Yes' ELSE 'Yes/Yes/Yes' END"


@query(_FRAG_SQL + f"SELECT {_ROW_PATTERN} AS pattern, count(*) AS n FROM keyed GROUP BY 1")
def answer_pattern_histogram(spark, sf_dir):
    rows = curate.rows_mode(_survey(spark, sf_dir)).select(F.regexp_extract(F.col("conversations")[1]["value"], r"(?s)<answer>(.*)</answer>", 1).alias("v"))
    return curate.answer_patterns(rows, "v")


@query(_FRAG_SQL + "SELECT category, count(*) AS n, count(*) FILTER (WHERE video IS NULL) AS skipped FROM k GROUP BY category")
def category_counters(spark, sf_dir):
    return curate.category_counts(_survey(spark, sf_dir))


@query(
    "WITH s AS (SELECT event_id, event_id % 34 = 0 AS nov, CASE WHEN event_id % 6 = 0 OR event_id % 7 = 0 THEN 'Yes' END AS d FROM events) SELECT count(*) AS source_rows, count(*) FILTER (WHERE nov) AS without_video, "
    "count(*) FILTER (WHERE d IS NULL) AS undecided, count(*) FILTER (WHERE NOT nov AND d IS NOT NULL) AS items, count(*) FILTER (WHERE NOT nov AND d = 'Yes') AS yes, count(*) FILTER (WHERE NOT nov AND d = 'No') AS no FROM s"
)
def conversion_counts(spark, sf_dir):
    rows = _survey(spark, sf_dir)
    return curate.conversion_stats(rows, curate.single_issue_fallbacks("physics_violation", "It obeys physics.")["decision"])


@query("SELECT event_id, CASE WHEN event_id % 34 = 0 THEN '' WHEN event_id % 17 = 0 THEN concat('http://h/', user_id) ELSE concat('v/', user_id, '.mp4') END AS auto_ref, CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('v/', user_id, '.mp4') END AS path_ref FROM events")
def video_refs(spark, sf_dir):
    return _survey(spark, sf_dir).select(F.col("_seq").alias("event_id"), curate.video_ref().alias("auto_ref"), curate.video_ref("path").alias("path_ref"))


# -- samples and splits --------------------------------------------------------------------------


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= CAST(floor(n * 0.2) AS BIGINT)")
def exact_sample_rate(spark, sf_dir):
    name, rate = split.sampling_rate("documents%20")
    return split.exact_sample(table(spark, sf_dir, name), rate, "doc_id").select("doc_id", "source")


_SPLIT_SQL = """
WITH n AS (SELECT quality || '/' || toxic AS label, doc_id, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM labels),
g AS (SELECT label, count(*) AS n, min(doc_id) AS first, count(*) * 50 / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM n GROUP BY label),
p AS (SELECT *, floor(share) AS fl, row_number() OVER (ORDER BY share - floor(share) DESC, n DESC, first) AS r, 50 - sum(floor(share)) OVER () AS rest FROM g),
t AS (SELECT label, n, CAST(fl + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS take FROM p)
"""


def _quality_split(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return split.stratified_split(rows, F.concat_ws("/", "quality", "toxic"), "doc_id", 50)


@query(_SPLIT_SQL + "SELECT doc_id, n.label, CASE WHEN rn <= take THEN 'test' ELSE 'train' END AS split FROM n JOIN t ON n.label = t.label")
def stratified_split_rows(spark, sf_dir):
    return _quality_split(spark, sf_dir).select("doc_id", "label", "split")


@query(_SPLIT_SQL + "SELECT label, 'test' AS split, take AS n FROM t WHERE take > 0 UNION ALL SELECT label, 'train', n - take FROM t WHERE n > take")
def stratified_split_counts(spark, sf_dir):
    return _quality_split(spark, sf_dir).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, COALESCE(nullif(trim(regexp_replace(regexp_extract(t, '<answer>\\s*(.*?)\\s*</answer>', 1, 'is'), '\\s+', ' ', 'g')), ''), 'UNKNOWN') AS label FROM (SELECT doc_id, {SINGLE_SAID} AS t FROM labels)")
def split_labels(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", t=SINGLE_SAID)
    turns = F.array(F.struct(F.lit("human").alias("from"), F.lit("q").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("t").alias("value")))
    return rows.select("doc_id", labels.split_label(turns).alias("label"))


@query("SELECT doc_id % 3 AS shard, count(*) AS n, sum(doc_id // 8) AS chunks FROM documents GROUP BY 1")
def stride_shards(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    shard = F.when(split.stride(F.col("doc_id"), 0, 3), 0).when(split.stride(F.col("doc_id"), 1, 3), 1).otherwise(2).cast("long")
    return rows.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum(split.chunk(F.col("doc_id"), 8)).cast("decimal(38,0)").cast("double").alias("chunks"))


SQL["stride_shards"] = "SELECT doc_id % 3 AS shard, count(*) AS n, CAST(sum(doc_id // 8) AS DOUBLE) AS chunks FROM documents GROUP BY 1"


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1 AND value >= 0.5")
def best_by_score(spark, sf_dir):
    return split.best(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id", 0.5).select("user_id", "event_id", "value")


@query("SELECT doc_id FROM documents WHERE doc_id >= 10 AND doc_id < 210")
def slice_scan(spark, sf_dir):
    return split.slice_rows(table(spark, sf_dir, "documents"), "doc_id", 10, 200).select("doc_id")


@query("SELECT doc_id, md5(text) AS digest FROM (SELECT doc_id, text FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 1)")
def random_lookup(spark, sf_dir):
    return split.pick(table(spark, sf_dir, "documents"), "doc_id", seed=7).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


# -- resuming and merging -------------------------------------------------------------------------


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_left_anti(spark, sf_dir):
    return joins.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT text AS sample, count(*) AS n FROM (SELECT md5(text) AS text FROM documents) GROUP BY text HAVING count(*) > 1")
def content_key_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("key", text.content_key(F.col("text")))
    return rows.groupBy("key").agg(F.min(F.md5(F.col("text").cast("binary"))).alias("sample"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("key")


_SHARD = "SELECT event_id - event_id % 4 AS k, event_id % 3 AS file, event_id AS line, value FROM events"


@query(
    f"WITH s AS ({_SHARD}), l AS (SELECT k, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY file DESC, line DESC) AS rn FROM s) WHERE rn = 1) "
    "SELECT e.event_id, CASE WHEN l.k IS NOT NULL THEN l.value ELSE e.value END AS value FROM events e LEFT JOIN l ON e.event_id = l.k"
)
def shard_upsert_last_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    shards = events.select((F.col("event_id") - F.col("event_id") % 4).alias("event_id"), (F.col("event_id") % 3).alias("file"), F.col("event_id").alias("line"), "value")
    return joins.upsert(events.select("event_id", "value"), shards, "event_id", ["file", "line"], ["value"])


@query(f"WITH s AS ({_SHARD}), f AS (SELECT k, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY file, line) AS rn FROM s) WHERE rn = 1) SELECT e.event_id AS k, f.value, e.event_id AS place FROM events e JOIN f ON e.event_id = f.k")
def union_first_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    shards = events.select((F.col("event_id") - F.col("event_id") % 4).alias("k"), (F.col("event_id") % 3).alias("file"), F.col("event_id").alias("line"), "value")
    found = joins.union_first(shards, events.select(F.col("event_id").alias("k"), F.col("event_id").alias("place")), "k", ["file", "line"], "place")
    return found.select("k", "value", "place")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN concat('Video Caption: s', doc_id) WHEN doc_id % 3 = 0 THEN concat('Video Caption: b', doc_id) ELSE 'plain' END AS t FROM labels")
def conditional_positional_merge(spark, sf_dir):
    base = rendered(spark, sf_dir, "labels", "doc_id", t="CASE WHEN doc_id % 3 = 0 THEN concat('Video Caption: b', CAST(doc_id AS STRING)) ELSE 'plain' END")
    shard = rendered(spark, sf_dir, "labels", "doc_id", t="CASE WHEN doc_id % 2 = 0 THEN concat('Video Caption: s', CAST(doc_id AS STRING)) ELSE 'none' END")
    return joins.conditional_merge(base, shard, "doc_id", "t", lambda v: F.startswith(v, F.lit("Video Caption:")))


@query(
    "SELECT m.event_id, COALESCE(max(s.event_id), -1) AS span_id FROM events m LEFT JOIN events s ON s.user_id = m.user_id AND s.event_type = 'view' AND s.event_id <= m.event_id WHERE m.event_type <> 'view' GROUP BY m.event_id"
)
def noun_asof_time_span(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    spans = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("span_id"))
    return joins.as_of(events.where("event_type <> 'view'"), spans.withColumn("e", F.col("span_id")), ["user_id"], "event_id", "e", ["span_id"]).select("event_id", F.coalesce("span_id", F.lit(-1)).alias("span_id"))


@query("SELECT user_id, event_id, COALESCE(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS until FROM events")
def span_lead(spark, sf_dir):
    return joins.until_next(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", F.lit(-1).cast("long"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN concat('a/', d.doc_id) ELSE concat('b/', d.doc_id) END AS path FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE l.doc_id IS NOT NULL OR d.doc_id IN (SELECT page_id FROM pages)")
def first_existing_path(spark, sf_dir):
    docs, known = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    named = lambda df, p: df.select(F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("path"))
    files = named(known, "a/").unionByName(named(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), "b/"))
    tries = docs.select("doc_id", F.posexplode(F.array(*[F.concat(F.lit(p), F.col("doc_id").cast("string")) for p in ("a/", "b/")])).alias("rank", "path"))
    return joins.first_existing(tries, files, ["doc_id"], "rank", "path")


# -- tagged text ----------------------------------------------------------------------------------


@query(
    rf"SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '<t>.*?</t>', ' ', 'gs'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g')) AS cleaned, CAST(len(regexp_extract_all(t, '<t>.*?</t>', 0, 's')) AS INTEGER) AS n_tags FROM (SELECT event_id, {SPANS} AS t FROM events)"
)
def strip_time_tags(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", t=SPANS)
    return rows.select("event_id", text.strip_time_tags(F.col("t")).alias("cleaned"), text.time_tag_count(F.col("t")).alias("n_tags"))


@query(
    f"SELECT event_id, concat('<think>Physics violation issue: <t>', event_id % 9, '.0s</t> to <t>', event_id % 7 + 3, '.5s</t> The ball floats. ', CASE WHEN event_id % 3 = 0 THEN '<t>1.0s</t> to <t>2.0s</t> It  falls down.' ELSE 'Rest.' END, '</think>\n<answer>', {YN('event_id % 4 <> 0')}, '</answer>') AS t FROM events"
)
def time_point_normalise(spark, sf_dir):
    return rendered(spark, sf_dir, "events", "event_id", t=SPANS).select("event_id", text.point_tags(F.col("t")).alias("t"))


@query(
    "SELECT event_id, CAST(0 AS INTEGER) AS pos, CAST(event_id % 9 AS DOUBLE) AS start_sec, CAST(event_id % 7 + 3.5 AS DOUBLE) AS end_sec, CASE WHEN event_id % 3 = 0 THEN ' The ball floats. ' ELSE ' The ball floats. Rest.' END AS evidence FROM events "
    "UNION ALL SELECT event_id, CAST(1 AS INTEGER), 1.0, 2.0, ' It  falls down.' FROM events WHERE event_id % 3 = 0"
)
def span_evidence_lead(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", t=SPANS)
    return rows.select("event_id", F.posexplode(text.time_spans(F.col("t"))).alias("pos", "s")).select("event_id", "pos", "s.*")


@query("SELECT event_id, CAST(greatest(event_id % 7 + 3.5 - event_id % 9, 0) + CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0 END AS DOUBLE) AS score FROM events")
def time_tag_scores(spark, sf_dir):
    return rendered(spark, sf_dir, "events", "event_id", t=SPANS).select("event_id", text.time_tag_score(F.col("t")).alias("score"))


@query(
    "SELECT event_id, rtrim(rtrim(printf('%.1f', value), '0'), '.') AS one, concat('<t>', rtrim(rtrim(printf('%.1f', value), '0'), '.'), 's-', event_id % 50, 's</t>') AS tag, "
    "concat('<t>', CASE WHEN abs(value - round_even(value, 0)) < 1e-6 THEN CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', value) END, 's</t><box>[1,2,', event_id % 7, ']</box> to <t>', event_id % 50, 's</t>') AS note FROM events"
)
def time_formats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_id") % 50).alias("e"))
    box = F.array(F.lit(1), F.lit(2), (F.col("event_id") % 7).cast("int"))
    return rows.select("event_id", text.format_second(F.col("value")).alias("one"), text.range_tag(F.col("value"), F.col("e")).alias("tag"), text.time_annotation(F.col("value"), F.col("e").cast("double"), box, F.lit(None).cast("array<int>")).alias("note"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+', ' ', 'g'), ' .,:;""''') AS t FROM pages".replace('""', '"'))
def html_tag_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_evidence(F.col("html")).alias("t"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(concat('x', props)) AS broken, json_extract_string(props, '$.k') AS loose FROM events")
def json_prop_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    wrapped = F.concat(F.lit("so: "), F.col("props"), F.lit(" !"))
    return rows.select(
        "event_id", F.get_json_object(text.json_object(F.col("props")), "$.k").cast("long").alias("k"),
        text.json_object(F.concat(F.lit("x"), F.col("props"))).isNotNull().alias("broken"), F.get_json_object(text.loose_json(wrapped), "$.k").alias("loose"),
    )


@query(
    "SELECT event_id, event_id % 4 <> 0 AS is_yes, 'floats' AS verb, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS spans, concat('<t>', event_id % 9, 's-', event_id % 7 + 3, '.5s</t> The ball floats.') AS lead FROM events"
)
def response_parts(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", t=SPANS)
    think = text.found_tag(F.col("t"), "think", F.lit(""))
    return rows.select(
        "event_id", labels.answer_is_yes(F.col("t")).alias("is_yes"), F.regexp_extract(think, r"ball (\w+)\.", 1).alias("verb"), F.size(text.time_spans(F.col("t"))).alias("spans"),
        F.regexp_extract(text.first_tag(F.col("t"), "think"), r"(<t>[^<]*</t> [^.]*\.)", 1).alias("lead"),
    )


_EVID = "CASE event_id % 5 WHEN 0 THEN 'Physics violation issue: The ball floats up.' WHEN 1 THEN 'A gap between the hand and the red cup, oddly.' WHEN 2 THEN 'The scene.' WHEN 3 THEN '<t>1s</t> Tall man''s arm bends. More' ELSE 'Nothing here' END"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ball' WHEN 1 THEN 'red cup' WHEN 3 THEN '1s Tall man' WHEN 4 THEN 'Nothing here' END AS object, CASE event_id % 5 WHEN 0 THEN 'physics violation issue the ball floats up' WHEN 1 THEN 'a gap between the hand and the red cup oddly' WHEN 2 THEN 'the scene' WHEN 3 THEN 'tall man s arm bends more' ELSE 'nothing here' END AS k FROM events")
def object_prompts(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", e=_EVID.replace("''", "\\'"))
    return rows.select("event_id", text.heuristic_object_prompt(F.col("e"), 6).alias("object"), text.evidence_key(F.col("e")).alias("k"))


_OLD = (
    "concat('<think>\nVideo Quality: Good.\nSubject Movement: Good', CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' for now' END, '\nPhysical Interaction, Cause-Effect: Ball floats\n', CASE WHEN doc_id % 3 = 0 THEN 'No heading here' ELSE '' END, '\n</think>\n', "
    + SEVEN + ")"
)


@query(
    f"WITH s AS (SELECT doc_id, quality = 1 AS vq, doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 <> 0 AS mo, toxic = 0 AND doc_id % 13 <> 0 AS pa FROM labels) SELECT doc_id, '<think>\n' || "
    "concat_ws('\n', CASE WHEN vq THEN 'Video Quality: Good.' END, concat('Motion & Interaction: ', concat_ws(' ', CASE WHEN mo THEN CASE WHEN doc_id % 2 = 0 THEN 'Good.' ELSE 'Good for now.' END WHEN doc_id % 2 <> 0 THEN 'for now.' END, 'Ball floats.', CASE WHEN doc_id % 3 = 0 THEN 'No heading here.' END))) "
    "|| '\n</think>\n<answer>\nVideo Quality: ' || CASE WHEN vq THEN 'Yes' ELSE 'No' END || '. Motion & Interaction: ' || CASE WHEN mo THEN 'Yes' ELSE 'No' END || '. Prompt Alignment: ' || CASE WHEN pa THEN 'Yes' ELSE 'No' END || '.\n</answer>' AS value FROM s"
)
def merge_rewrite(spark, sf_dir):
    return rendered(spark, sf_dir, "labels", "doc_id", t=_OLD).select("doc_id", rewrite.merged_response(F.col("t")).alias("value"))


_CLAIMED = (
    "concat('<think>\n[Visual Quality]: ', CASE WHEN quality = 1 THEN 'Good' ELSE 'Blurred frames. Blurred frames!' END, '\n[Motion & Physical Consistency]: ', CASE WHEN doc_id % 2 = 0 THEN 'It jumps. I believe the video is AI. It jumps.' ELSE 'Good' END, "
    "'\n[Prompt Alignment]: ', CASE WHEN doc_id % 3 = 0 THEN 'It jumps. No cat.' ELSE 'Good' END, '\n</think>\n', " + SEVEN + ")"
)


@query(
    "WITH s AS (SELECT doc_id, quality = 1 AS vq, doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS b, doc_id % 5 <> 0 AS c, toxic = 0 AS oe, doc_id % 13 = 0 AS un FROM labels), "
    "r AS (SELECT *, CASE WHEN a THEN 'It jumps.' ELSE 'Good' END AS mr, CASE WHEN doc_id % 3 = 0 THEN 'It jumps. No cat.' ELSE 'Good' END AS pr FROM s) "
    "SELECT doc_id, concat_ws('\n', CASE WHEN vq THEN 'Video Quality: Good.' ELSE 'Video Quality: Blurred frames.' END, "
    "CASE WHEN a OR b OR c THEN concat_ws(', ', CASE WHEN a THEN 'Subject Movement' END, CASE WHEN b THEN 'Physical Interaction' END, CASE WHEN c THEN 'Cause-Effect' END) || ': Good.' END, "
    "CASE WHEN NOT (a AND b AND c) THEN concat_ws(', ', CASE WHEN NOT a THEN 'Subject Movement' END, CASE WHEN NOT b THEN 'Physical Interaction' END, CASE WHEN NOT c THEN 'Cause-Effect' END) || ': ' || mr END, "
    "concat_ws(', ', 'Subject Existence', CASE WHEN oe THEN 'Object Existence' END, CASE WHEN NOT un THEN 'Subject-Object Interaction' END) || ': Good.', CASE WHEN NOT oe THEN 'Object Existence: ' || pr END) AS lines FROM r"
)
def reasoning_lines(spark, sf_dir):
    return rendered(spark, sf_dir, "labels", "doc_id", t=_CLAIMED).select("doc_id", rewrite.reasoning_lines(F.col("t")).alias("lines"))


@query(
    "WITH s AS (SELECT doc_id, quality = 1 AS vq, doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 <> 0 AS mo, toxic = 0 AND doc_id % 13 <> 0 AS pa FROM labels) SELECT doc_id, CASE WHEN vq THEN 'The video quality is good.' ELSE 'Blurred frames.' END AS visual, "
    "CASE WHEN mo THEN 'The subject movement, physical interaction, and cause-effect are all reasonable.' WHEN doc_id % 2 = 0 THEN 'It jumps.' ELSE 'Good' END AS motion, "
    "CASE WHEN pa THEN 'The video is well aligned with the prompt.' WHEN doc_id % 3 <> 0 THEN CASE WHEN NOT mo AND doc_id % 2 <> 0 THEN 'The video is not fully aligned with the prompt.' ELSE 'Good' END WHEN NOT mo AND doc_id % 2 = 0 THEN 'No cat.' ELSE 'It jumps. No cat.' END AS prompt FROM s"
)
def reasoning_texts(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", t=_CLAIMED)
    return rows.select("doc_id", *[c.alias(k) for k, c in rewrite.reasoning_texts(F.col("t")).items()])


@query(
    "SELECT doc_id, concat_ws('\n', '[Visual Quality]: ' || CASE WHEN quality = 1 THEN 'Good' ELSE '<t>0.5s-1.0s</t> Blurred frames. Blurred frames!' END, "
    "'[Motion & Physical Consistency]: ' || CASE WHEN doc_id % 2 = 0 THEN 'It jumps. I believe the video is AI. It jumps.' ELSE 'Good' END, '[Prompt Alignment]: ' || CASE WHEN doc_id % 3 = 0 THEN 'It jumps. No cat.' ELSE 'Good' END) AS think FROM labels"
)
def interval_tagging(spark, sf_dir):
    given = F.array(*[F.struct(F.lit(0.5).alias("start_sec"), F.lit(1.0).alias("end_sec"), F.lit(c).alias("confidence"), F.lit(e).alias("error")) for c, e in ((0.9, False), (0.1, False), (0.9, True))])
    rows = rendered(spark, sf_dir, "labels", "doc_id", t=_CLAIMED)
    return rows.select("doc_id", text.first_tag(infer.tag_intervals(F.col("t"), given, 0.5), "think").alias("think"))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<think>\nVideo Caption: a cat' ELSE '<think>\nVideo Caption: a cat\nbody' END || '</think>' AS captioned, doc_id % 2 = 0 AS had FROM labels"
)
def caption_insert(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", t="CASE WHEN doc_id % 2 = 0 THEN '<think>\nVideo Caption: old one</think>' ELSE '<think>\nbody</think>' END")
    line = text.insert_caption(F.col("t"), text.clean_caption(F.lit(' Caption: "a  cat" ')))
    return rows.select("doc_id", F.when(F.endswith(line, F.lit("</think>")), line).otherwise(F.concat(line, F.lit("</think>"))).alias("captioned"), text.has_caption(F.col("t")).alias("had"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'kept. [Prompt Alignment]: Fine. It lacks a dog.' ELSE 'kept. [Prompt Alignment]: Fine.' END || '</think><answer>Subject-Object Interaction: ' || CASE WHEN doc_id % 2 = 0 THEN 'No.' ELSE 'Yes.' END || '</answer>' AS fixed FROM labels")
def fix_subject_object(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", t="concat('kept. [Prompt Alignment]: Fine.</think><answer>Subject-Object Interaction: ', CASE WHEN doc_id % 2 = 0 THEN 'It lacks a dog..' ELSE 'Yes.' END, '</answer>')")
    return rows.select("doc_id", text.fix_subject_object(F.col("t")).alias("fixed"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE regexp_extract(t, '<answer>(.*)</answer>', 1) END AS line FROM (SELECT doc_id, {SEVEN} AS t FROM labels)")
def ordered_answers(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", t=SEVEN)
    return rows.select("doc_id", labels.ordered_answer(text.first_tag(F.col("t"), "answer")).alias("line"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('cat ', doc_id, '.') END AS loose, CASE WHEN doc_id % 2 = 0 THEN concat('cat ', doc_id, '..') ELSE '' END AS strict FROM labels")
def textual_prompts(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", t="CASE WHEN doc_id % 2 = 0 THEN concat('Textual prompt: cat ', CAST(doc_id AS VARCHAR(20)), '..\nAssess whether the video is well-aligned') ELSE 'none' END")
    return rows.select("doc_id", rewrite.textual_prompt(F.col("t")).alias("loose"), F.coalesce(text.prompt_between(F.col("t"), loose=False), F.lit("")).alias("strict"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'x</s>y</answer>' WHEN 1 THEN 'a<|im_end|>' WHEN 2 THEN 'q</s>' ELSE 'open' END AS t FROM labels")
def trim_responses(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", t="CASE doc_id % 4 WHEN 0 THEN 'x</s>y</answer>z' WHEN 1 THEN 'a<|im_end|>b' WHEN 2 THEN 'q</s>r' ELSE ' open ' END")
    return rows.select("doc_id", text.trim_repeated_response(F.col("t")).alias("t"))


@query("SELECT doc_id, 'a__b__c' || doc_id AS stem, CASE WHEN doc_id % 2 = 0 THEN '/x/a.mp4' ELSE '/root/a.mp4' END AS path, doc_id % 3 <> 0 AS skip FROM labels")
def path_and_claim_helpers(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", p="concat('a/b/c', CAST(doc_id AS VARCHAR(20)), '.mp4')", q="CASE WHEN doc_id % 2 = 0 THEN '/x/a.mp4' ELSE 'a.mp4' END", c="CASE WHEN doc_id % 3 = 0 THEN 'It falls' ELSE '<t>1s-2s</t> GOOD one' END")
    return rows.select("doc_id", text.safe_stem(F.col("p")).alias("stem"), text.absolute_path(F.lit("/root"), F.col("q")).alias("path"), text.should_skip_claim(F.col("c")).alias("skip"))


# -- numbers ----------------------------------------------------------------------------------------

_BOXES = "SELECT l_orderkey AS o, l_linenumber AS n, CAST(l_partkey % 100 AS INTEGER) AS x1, CAST(l_suppkey % 100 AS INTEGER) AS y1, CAST(l_partkey % 100 + l_linenumber * 20 AS INTEGER) AS x2, CAST(l_suppkey % 100 + 30 AS INTEGER) AS y2 FROM lineitem"


def _boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS o", "l_linenumber AS n", "CAST(l_partkey % 100 AS INT) AS x1", "CAST(l_suppkey % 100 AS INT) AS y1", "CAST(l_partkey % 100 + l_linenumber * 20 AS INT) AS x2", "CAST(l_suppkey % 100 + 30 AS INT) AS y2",
    )
    return rows.withColumn("b", F.array("x1", "y1", "x2", "y2"))


@query(
    f"WITH b AS ({_BOXES}), i AS (SELECT *, greatest(0, least(x2, 60) - greatest(x1, 10)) * greatest(0, least(y2, 70) - greatest(y1, 20)) AS inter FROM b) "
    "SELECT o, n, round(CASE WHEN (x2 - x1) * (y2 - y1) + 2500 - inter > 0 THEN CAST(inter AS DOUBLE) / ((x2 - x1) * (y2 - y1) + 2500 - inter) ELSE 0.0 END, 9) AS iou FROM i"
)
def bbox_iou_pairs(spark, sf_dir):
    other = F.array(F.lit(10), F.lit(20), F.lit(60), F.lit(70))
    return _boxes(spark, sf_dir).select("o", "n", F.round(geometry.iou(F.col("b"), other), 9).alias("iou"))


_C = "CAST(least(1000, greatest(0, round_even({0}, 0))) AS INTEGER)"


@query(
    f"WITH b AS ({_BOXES}) SELECT o, n, concat_ws(',', {_C.format('x1 / 640.0 * 1000')}, {_C.format('y1 / 428.0 * 1000')}, {_C.format('x2 / 640.0 * 1000')}, {_C.format('y2 / 428.0 * 1000')}) AS rel, "
    f"concat_ws(',', x1, y1, x1 + x2, y1 + y2) AS xyxy, "
    "concat_ws(',', CAST(least(639, greatest(0, round_even(x1 / 1000.0 * 640, 0))) AS INTEGER), CAST(least(427, greatest(0, round_even(y1 / 1000.0 * 428, 0))) AS INTEGER), CAST(least(639, greatest(0, round_even(x2 / 1000.0 * 640, 0))) AS INTEGER), CAST(least(427, greatest(0, round_even(y2 / 1000.0 * 428, 0))) AS INTEGER)) AS pixels FROM b".replace("1000.0", "CAST(1000 AS DOUBLE)")
)
def bbox_scaling(spark, sf_dir):
    h, w, line = F.lit(428), F.lit(640), lambda b: F.array_join(b.cast("array<string>"), ",")
    return _boxes(spark, sf_dir).select("o", "n", line(geometry.relative_box(F.col("b"), h, w)).alias("rel"), line(geometry.xywh_to_xyxy(F.col("b"))).alias("xyxy"), line(geometry.pixel_box(F.col("b"), w, h)).alias("pixels"))


SQL["bbox_scaling"] = SQL["bbox_scaling"].replace("/ 640.0 * 1000", "/ CAST(640 AS DOUBLE) * 1000").replace("/ 428.0 * 1000", "/ CAST(428 AS DOUBLE) * 1000")


@query(
    "WITH s AS (SELECT p_partkey, p_size * 40 + 28 AS h, p_size * 17 + 30 AS w FROM part), b AS (SELECT *, round_even(CAST(h AS DOUBLE) / 28, 0) * 28 AS hb, round_even(CAST(w AS DOUBLE) / 28, 0) * 28 AS wb, sqrt(CAST(h AS DOUBLE) * w / 1003520) AS dn, sqrt(CAST(3136 AS DOUBLE) / (CAST(h AS DOUBLE) * w)) AS up FROM s) "
    "SELECT p_partkey, CAST(CASE WHEN hb * wb > 1003520 THEN floor(h / dn / 28) * 28 WHEN hb * wb < 3136 THEN ceil(h * up / 28) * 28 ELSE hb END AS INTEGER) AS height, CAST(CASE WHEN hb * wb > 1003520 THEN floor(w / dn / 28) * 28 WHEN hb * wb < 3136 THEN ceil(w * up / 28) * 28 ELSE wb END AS INTEGER) AS width FROM b"
)
def smart_resize(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size * 40 + 28 AS h", "p_size * 17 + 30 AS w")
    h, w = geometry.smart_size(F.col("h"), F.col("w"))
    return rows.select("p_partkey", h.alias("height"), w.alias("width"))


@query(
    "SELECT event_id, CAST(CASE WHEN event_id % 60 = 0 THEN 0 ELSE greatest(0, least(CAST(trunc(value * 24) AS BIGINT), event_id % 60 - 1)) END AS INTEGER) AS frame, round(least(8.0, greatest(0.0, least(value - 3, 20.0 - value))), 6) AS a, "
    "concat_ws(',', list_transform(range(0, 4), lambda k: printf('%.3f', least(value, (k + 0.5) * (value / 4))))) AS mids FROM events".replace("concat_ws(',', list", "array_to_string(list").replace("(value / 4)))))", "(value / 4)))), ',')")
)
def frame_index_math(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    a, _ = geometry.clamp_interval(F.col("value") - 3, F.lit(20.0) - F.col("value"), F.lit(8.0))
    mids = F.transform(geometry.bin_middles(F.col("value"), F.lit(4)), lambda x: F.replace(F.format_number(x, 3), F.lit(","), F.lit("")))
    return rows.select("event_id", geometry.frame_index(F.col("value"), F.lit(24.0), (F.col("event_id") % 60).cast("int")).alias("frame"), F.round(a, 6).alias("a"), F.array_join(mids, ",").alias("mids"))


@query(
    "SELECT event_id, array_to_string(list_transform(range(0, 4), lambda k: CAST(round_even(k * (CAST(event_id % 50 AS DOUBLE) / 3), 0) AS INTEGER)), ',') AS even, array_to_string(list_transform(range(0, CAST(event_id % 7 + 1 AS BIGINT)), lambda k: k // 3), ',') AS grp, "
    "CAST(least(16, greatest(4, round_even(CAST(event_id % 50 AS DOUBLE) / 2, 0))) AS INTEGER) AS taken FROM events"
)
def frame_sampling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 50 + 1).cast("int").alias("n"), (F.col("event_id") % 7 + 1).cast("int").alias("g"))
    groups = F.flatten(F.transform(geometry.temporal_groups(F.col("g"), 3), lambda g, k: F.transform(g, lambda _: k)))
    return rows.select("event_id", F.array_join(geometry.even_frames(F.col("n"), F.lit(4)).cast("array<string>"), ",").alias("even"), F.array_join(groups.cast("array<string>"), ",").alias("grp"), geometry.clip_frames(F.col("n") - 1, F.lit(2.0), 4, 16).alias("taken"))


@query(
    "WITH t AS (SELECT conv_id, turn, len(text) AS n FROM conversations WHERE text IS NOT NULL) SELECT conv_id, CAST(turn AS BIGINT) AS turn, array_to_string(list_transform(range(0, n // 10 + 1), lambda k: CASE WHEN k * 10 < n // 2 AND k * 10 + 10 > n // 4 THEN k ELSE -100 END), ',') AS labelled FROM t"
)
def token_label_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.length("text").alias("n"))
    tokens = F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / 10).cast("int")), lambda k: F.struct((k * 10).alias("begin"), (k * 10 + 10).alias("end"), k.alias("id")))
    spans = F.array(F.struct(F.floor(F.col("n") / 4).alias("begin"), F.floor(F.col("n") / 2).alias("end")))
    return rows.select("conv_id", "turn", F.array_join(arrays.label_tokens(tokens, spans).cast("array<string>"), ",").alias("labelled"))


def _sequences(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null").selectExpr("conv_id", "turn", "CAST(length(text) % 6 + 1 AS INT) AS n")
    ids = F.sequence(F.lit(1), F.col("n"))
    return rows.select("conv_id", "turn", ids.alias("ids"), ids.alias("labels"), F.transform(ids, lambda x: x - 1).alias("positions"))


@query(
    "WITH s AS (SELECT conv_id, turn, least(len(text) % 6 + 1, 4) AS n FROM conversations WHERE text IS NOT NULL), m AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS w FROM s) SELECT conv_id, turn, array_to_string(list_transform(range(1, w + 1), lambda k: CASE WHEN k <= n THEN k ELSE 0 END), ',') AS ids, "
    "array_to_string(list_transform(range(1, w + 1), lambda k: CASE WHEN k <= n THEN k ELSE -100 END), ',') AS labels, array_to_string(list_transform(range(1, w + 1), lambda k: CASE WHEN k <= n THEN k - 1 ELSE 1 END), ',') AS positions, array_to_string(list_transform(range(1, w + 1), lambda k: CASE WHEN k <= n THEN 1 ELSE 0 END), ',') AS mask FROM m"
)
def pad_collate(spark, sf_dir):
    out = arrays.collate(_sequences(spark, sf_dir), "conv_id", 4)
    return out.select("conv_id", "turn", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ids", "labels", "positions", "mask")])


@query("WITH s AS (SELECT conv_id, turn, len(text) % 6 + 1 AS n FROM conversations WHERE text IS NOT NULL), c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, n ROWS UNBOUNDED PRECEDING) AS cu FROM s) SELECT conv_id, '0,' || string_agg(CAST(cu AS VARCHAR), ',' ORDER BY cu) AS cu_seqlens, CAST(max(cu) AS INTEGER) AS total FROM c GROUP BY conv_id")
def cu_seqlens(spark, sf_dir):
    out = arrays.flatten_batch(_sequences(spark, sf_dir), "conv_id", "turn")
    return out.select("conv_id", F.array_join(F.col("cu_seqlens").cast("array<string>"), ",").alias("cu_seqlens"), F.size("ids").alias("total"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 1e-6), 6) AS s FROM embeddings")
def l2_normalise(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", arrays.l2_normalise(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query(
    "WITH p AS (SELECT label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS l FROM embeddings), d AS (SELECT label, sqrt(list_sum(list_transform(list_zip(e, l), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))) AS x FROM p WHERE l IS NOT NULL) "
    "SELECT label, round(avg(x), 6) AS mean_step, round(max(x), 6) AS max_step, round(min(x), 6) AS min_step FROM d GROUP BY label"
)
def adjacent_diff(spark, sf_dir):
    out = arrays.adjacent_changes(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("mean_step", "max_step", "min_step")])


@query(
    "WITH m AS (SELECT event_type, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events GROUP BY 1) SELECT event_id, CAST(trunc(greatest(0.0, least(1.0, (value - a) / (b - a))) * 255) AS INTEGER) AS scaled FROM events JOIN m USING (event_type)"
)
def robust_percentile_scale(spark, sf_dir):
    return arrays.robust_scale(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_id", "scaled")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '0,1,2,3,7' WHEN 1 THEN '5' WHEN 2 THEN '2,3,1' ELSE '0' END AS idx, CAST(CASE event_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS t FROM events")
def index_lists_and_grids(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", i="CASE event_id % 4 WHEN 0 THEN '0-3,7,2' WHEN 1 THEN '5' WHEN 2 THEN '2-3, 1' ELSE '0,0' END", n="CASE event_id % 4 WHEN 0 THEN 64 WHEN 1 THEN 48 ELSE 36 END", f="CASE event_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END")
    return rows.select("event_id", F.array_join(arrays.index_list(F.col("i")).cast("array<string>"), ",").alias("idx"), arrays.square_grid(F.col("n"), F.col("f"))["t"].alias("t"))


@query("SELECT event_id, '0,1,-1,2' AS hidden, CASE WHEN event_id % 2 = 0 THEN '5,6,9' ELSE '5,9' END AS eos FROM events".replace("'0,1,-1,2'", "'0,1,0,2'"))
def masked_positions_and_eos(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    mask = F.array(*[F.lit(x) for x in (1, 1, 0, 1)])
    ids = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(5), F.lit(6))).otherwise(F.array(F.lit(5), F.lit(9)))
    line = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("event_id", line(arrays.masked_positions(mask)).alias("hidden"), line(arrays.with_eos(ids, 9)).alias("eos"))


# -- sequential algorithms: no SQL, tested by brute force and invariants ---------------------------------


_PAIR_IOU = "greatest(0, least(a.x2, b.x2 + 2) - greatest(a.x1, b.x1 + 2)) * greatest(0, least(a.y2, b.y2 + 2) - greatest(a.y1, b.y1 + 2))"


@query(f"""
WITH b AS ({_BOXES}), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY o ORDER BY n) - 1 AS INTEGER) AS k, count(*) OVER (PARTITION BY o) AS m FROM b),
pairs AS (SELECT a.o, a.k AS i, b.k AS j, a.m, CAST({_PAIR_IOU} AS DOUBLE) AS inter, CAST((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS DOUBLE) AS areas FROM k a JOIN k b ON a.o = b.o),
gains AS (SELECT o, i, j, m, CASE WHEN areas - inter > 0 THEN inter / (areas - inter) ELSE 0.0 END AS gain FROM pairs),
s0 AS (SELECT DISTINCT o, m, 0 AS used, CAST(0 AS DOUBLE) AS total FROM k),
{", ".join(f"s{i + 1} AS (SELECT s.o, s.m, s.used + (1 << g.j) AS used, max(s.total + g.gain) AS total FROM s{i} s JOIN gains g ON g.o = s.o AND g.i = {i} AND (s.used // (1 << g.j)) % 2 = 0 GROUP BY ALL)" for i in range(20))}
SELECT o, round(max(total) / any_value(m), 6) AS score FROM ({" UNION ALL ".join(f"SELECT * FROM s{i} WHERE m = {i}" for i in range(1, 21))}) GROUP BY o""")
def hungarian_iou(spark, sf_dir):
    b = _boxes(spark, sf_dir).groupBy("o").agg(F.array_sort(F.collect_list(F.struct("n", F.col("b").cast("array<double>").alias("b")))).alias("m"))
    boxes = F.transform("m", lambda m: m["b"])
    moved = F.transform(boxes, lambda q: F.transform(q, lambda x: x + 2))
    return b.select("o", F.round(arrays.matched_iou(boxes, moved), 6).alias("score"))


@query(rf"""
WITH RECURSIVE d AS (SELECT doc_id, doc_id // 256 AS block, COALESCE(len(list_filter(string_split_regex(text, '[\s\x0B\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{3000}}]+'), lambda x: x <> '')), 0) + 21 AS n FROM documents),
items AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, doc_id) AS k FROM d),
steps(block, k, rooms, doc_id, n, pack) AS (
  SELECT DISTINCT block, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM d
  UNION ALL
  SELECT block, k, CASE WHEN spot IS NULL THEN list_append(rooms, 4096 - n) ELSE list_transform(rooms, lambda r, j: CASE WHEN j = spot THEN r - n ELSE r END) END, doc_id, n, COALESCE(spot - 1, len(rooms))
  FROM (SELECT i.block, i.k, s.rooms, i.doc_id, i.n, list_position(s.rooms, list_min(list_filter(s.rooms, lambda r: r >= i.n))) AS spot FROM steps s JOIN items i ON i.block = s.block AND i.k = s.k + 1)
)
SELECT block, pack, doc_id, n AS n_tokens FROM steps WHERE k > 0""")
def bin_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(text.word_count(F.col("text")), F.lit(0)) + packing.FIXED_TOKENS).alias("n_tokens"))
    return packing.pack_blocks(docs, "doc_id", "n_tokens")


@query()
def principal_components(spark, sf_dir):
    rows = arrays.principal_maps(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), ["label"], "embedding", "vec_id")
    return rows.select("label", "vec_id", *[F.round(F.col("pca")[k], 4).alias(f"c{k + 1}") for k in range(3)])


@query(f"SELECT count(*) FILTER (WHERE event_id % 4 <> 0 AND event_id % 5 <> 0) AS pending_samples, CAST(sum(CASE WHEN event_id % 4 <> 0 AND event_id % 5 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END ELSE 0 END) AS BIGINT) AS pending_spans, count(*) FILTER (WHERE event_id % 4 <> 0 AND event_id % 5 = 0) AS missing_files, CAST(0 AS BIGINT) AS boxed FROM events")
def annotation_dry_run(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", t=SPANS)
    return infer.pending_report(rows, F.col("t"), F.col("event_id") % 5 != 0)


@query("WITH s AS (SELECT conv_id, turn, len(text) % 6 + 1 AS n FROM conversations WHERE text IS NOT NULL) SELECT conv_id, CAST(sum(n) AS INTEGER) AS n_ids, string_agg(array_to_string(range(0, n), ','), ',' ORDER BY turn, n) AS positions FROM s GROUP BY conv_id")
def pack_concat(spark, sf_dir):
    out = records.pack_concat(_sequences(spark, sf_dir), "conv_id", "turn")
    return out.select("conv_id", F.size("ids").alias("n_ids"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


