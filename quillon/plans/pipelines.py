"""Queries over whole pipelines, files and the smaller operators, beside those of ``queries``; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import arrays, geometry, labels, scan, text
from quillon.operators import annotate, curate, infer, joins, packing, records, rewrite, split
from quillon.plans.queries import _CLAIMED, _SURVEY, SEVEN, SPANS, YN, query, rendered, table
from quillon.scratch import shared_path
from quillon.sources import records as files
from quillon.sources.arrays import write_elements
from quillon.streaming import resume

#: White space as the engine's Unicode-aware patterns know it.
WS = r"[\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]"


def scratch(spark) -> str:
    """A folder of its own that driver and executors share."""
    return shared_path(spark, "files")


# -- boxes and captions -------------------------------------------------------------------------

_TAGS = r"'<t>\s*([0-9.]+)s\s*-\s*([0-9.]+)s\s*</t>'"


def _with_video(rows, video="concat('v', CAST(event_id % 5 AS VARCHAR(9)))"):
    return rows.selectExpr("*", f"{video} AS video", "CAST(10 AS DOUBLE) AS fps", "CASE WHEN event_id % 10 = 9 THEN 0 ELSE 60 END AS frames")


def _box_sql(sec, prompt):
    f = f"least(CAST(trunc({sec} * 10) AS INTEGER), 59)"
    return f"CASE WHEN {f} % 7 = 0 THEN NULL ELSE concat('[', {f} % 100, ',', length({prompt}), ',', {f} % 100 + 50, ',', length({prompt}) + 50, ']') END"


_SEC = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {0}) END"


def _note_sql(a, b, box_a, box_b):
    return f"concat('<t>', {_SEC.format(a)}, 's</t><box>', {box_a}, '</box> to <t>', {_SEC.format(b)}, 's</t><box>', {box_b}, '</box>')"


@query(f"""
WITH s AS (SELECT event_id, {SPANS} AS t, event_id % 10 <> 9 AND event_id % 4 <> 0 AS wanted, event_id % 4 <> 0 AS yes FROM events),
p AS (SELECT *, regexp_extract_all(t, {_TAGS}, 0) AS tags, CAST(regexp_extract(t, {_TAGS}, 1) AS DOUBLE) AS a1, CAST(regexp_extract(t, {_TAGS}, 2) AS DOUBLE) AS b1 FROM s),
b AS (SELECT *, {_box_sql('a1', "'ball'")} AS xa, {_box_sql('b1', "'ball'")} AS xb, {_box_sql('1.0', "'It'")} AS ya, {_box_sql('2.0', "'It'")} AS yb FROM p),
n AS (SELECT *, CASE WHEN wanted AND xa IS NOT NULL AND xb IS NOT NULL THEN {_note_sql('a1', 'b1', 'xa', 'xb')} END AS n1,
  CASE WHEN wanted AND len(tags) = 2 AND ya IS NOT NULL AND yb IS NOT NULL THEN {_note_sql('1.0', '2.0', 'ya', 'yb')} END AS n2 FROM b)
SELECT event_id, CASE WHEN len(tags) = 2 THEN replace(replace(t, tags[2], COALESCE(n2, tags[2])), tags[1], COALESCE(n1, tags[1])) ELSE replace(t, tags[1], COALESCE(n1, tags[1])) END AS value,
  CAST((n1 IS NOT NULL)::INTEGER + (n2 IS NOT NULL)::INTEGER AS INTEGER) AS annotated_spans, CAST(CASE WHEN yes THEN len(tags) ELSE 0 END - (n1 IS NOT NULL)::INTEGER - (n2 IS NOT NULL)::INTEGER AS INTEGER) AS skipped_spans,
  n1 IS NOT NULL OR n2 IS NOT NULL AS changed FROM n""")
def span_box_pipeline(spark, sf_dir):
    rows = _with_video(rendered(spark, sf_dir, "events", "event_id", value=SPANS))
    return annotate.annotate_spans(rows, "event_id").select("event_id", "value", "annotated_spans", "skipped_spans", "changed")


_NOUNS = "concat('<think><t>', CAST(event_id % 9 AS VARCHAR(9)), 's-9.5s</t> A cup and a dog by the cup.</think>\n<answer>Video Quality: ', " + YN("event_id % 4 = 0") + ", '.</answer>')"


@query(f"""
WITH s AS (SELECT event_id, {_NOUNS} AS t, event_id % 4 = 0 OR event_id % 10 = 9 AS plain FROM events),
p AS (SELECT *, regexp_replace(t, '<t>(\\d+)s-9.5s</t>', '<t>\\1.0s</t> to <t>9.5s</t>') AS pt, regexp_extract(t, '<t>(\\d+)s', 1) AS a, CAST(regexp_extract(t, '<t>(\\d+)s', 1) AS INTEGER) * 10 AS f FROM s),
m AS (SELECT *, concat(' at <t>', a, '.0s</t><box>[', f % 100, ', 3, ', f % 100 + 50, ', 53]</box>') AS put FROM p)
SELECT event_id, CASE WHEN plain OR f % 7 = 0 THEN pt ELSE replace(replace(pt, 'cup', concat('cup', put)), 'dog', concat('dog', put)) END AS value FROM m""".replace("CAST(regexp_extract(t, '<t>(\\d+)s', 1) AS INTEGER) * 10", "least(CAST(regexp_extract(t, '<t>(\\d+)s', 1) AS INTEGER) * 10, 59)"))
def noun_box_pipeline(spark, sf_dir):
    rows = _with_video(rendered(spark, sf_dir, "events", "event_id", value=_NOUNS))
    rows = rows.withColumns({"thinking": text.first_tag(F.col("value"), "think"), "nouns": F.array(F.lit("cup"), F.lit("dog"), F.lit("cup"), F.lit("bird"))})
    return annotate.annotate_nouns(rows, "event_id").select("event_id", "value")


@query(f"""
WITH s AS (SELECT event_id, {SPANS} AS t FROM events), p AS (SELECT *, regexp_extract(t, '<t>(\\d+)s', 1) AS a FROM s)
SELECT event_id, CAST(1 + (t LIKE '%It  falls%')::INTEGER AS INTEGER) AS n,
  replace(replace(t, 'ball', concat('ball at <t>', a, '.0s</t><box>[1, 2, 3, 4]</box>')), 'It  falls', 'It at <t>1.0s</t><box>[1, 2, 3, 4]</box>  falls') AS boxed FROM p""")
def noun_boxes(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", t=SPANS)
    found = rows.withColumn("m", scan.noun_mentions_udf("t", F.array(F.lit("ball"), F.lit("It"))))
    marks = F.transform("m", lambda m: F.struct(m["noun"].alias("noun"), m["start_sec"].alias("start_sec"), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("box")))
    return found.select("event_id", F.size("m").alias("n"), scan.place_boxes_udf("t", marks).alias("boxed"))


_CHAT = (
    "concat('<|im_start|>user\n<think>q</think><|im_end|>\n', CASE WHEN event_id % 7 = 0 THEN '' ELSE '<|im_start|>assistant\n' END, CASE event_id % 5 WHEN 0 THEN '<answer>no' WHEN 1 THEN 'so <answer>yes</answer>' WHEN 2 THEN '<think>open <answer>x</answer>' ELSE '<think>a</think> then <answer>b</answer>' END, "
    "' <|im_end|>', CASE WHEN event_id % 3 = 0 THEN '\n<|im_start|>assistant\n<answer>more</answer></s>' ELSE '' END)"
)
_LEARNED = r"'(?s)<think>.*?</think>(?:.*?<answer>.*?</answer>)?|<answer>.*?</answer>'"


@query(rf"""
WITH c AS (SELECT event_id, {_CHAT} AS chat FROM events),
t AS (SELECT *, list_filter(regexp_extract_all(chat, '(?s)<\|im_start\|>assistant\n(.*?)(?:<\|im_end\|>|</s>|\z)', 1), lambda x: x <> '') AS turns FROM c),
p AS (SELECT event_id, chat, unnest(flatten(list_transform(CASE WHEN len(turns) = 0 THEN [chat] ELSE turns END, lambda x: regexp_extract_all(x, {_LEARNED})))) AS part FROM t),
e AS (SELECT event_id, strpos(chat, part) - 1 AS b, chat, part FROM p),
x AS (SELECT event_id, b, b + length(part) + length(regexp_extract(substr(chat, b + length(part) + 1), '^\s*(?:<\|im_end\|>|</s>)?')) AS e FROM e)
SELECT c.event_id, COALESCE(string_agg(b || '-' || e, ',' ORDER BY b), '') AS spans FROM c LEFT JOIN x ON c.event_id = x.event_id GROUP BY c.event_id""")
def chat_label_spans(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", chat=_CHAT).withColumn("s", scan.label_spans_udf("chat"))
    line = F.transform("s", lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return rows.select("event_id", F.array_join(line, ",").alias("spans"))


_CLAIM3 = (
    "concat(CASE WHEN doc_id % 9 = 8 THEN 'none' ELSE concat('<think>\n[Visual Quality]: ', CASE WHEN quality = 1 THEN 'Good' ELSE 'Blurred. at 2' END, '\n[Motion & Physical Consistency]: ', CASE WHEN doc_id % 2 = 0 THEN 'It jumps at 9' ELSE '' END, "
    "'\n[Prompt Alignment]: bad number\n</think>') END, '\n<answer>No</answer>')"
)


@query(f"""
WITH s AS (SELECT doc_id, {_CLAIM3} AS t, concat('Look.. ', doc_id, '..') AS human, quality = 1 AS vq, doc_id % 2 = 0 AS mo,
  CASE WHEN doc_id % 9 = 8 THEN 'no think block' WHEN doc_id % 7 = 6 THEN 'video not found' WHEN doc_id % 5 = 4 THEN 'no frames' END AS error FROM labels)
SELECT doc_id, error, CASE WHEN error IS NULL THEN replace(human, '..', '.') ELSE human END AS human, CASE WHEN error IS NOT NULL THEN t ELSE concat('<think>\n[Visual Quality]: ',
  CASE WHEN vq THEN 'Good' ELSE '<t>2.0s-3.0s</t> Blurred. at 2' END, '\n[Motion & Physical Consistency]:', CASE WHEN mo THEN ' <t>8.0s-8.0s</t> It jumps at 9' ELSE '' END, '\n[Prompt Alignment]: bad number\n</think>\n<answer>No</answer>') END AS value FROM s""")
def claim_interval_pipeline(spark, sf_dir):
    def model():
        def answer(asked):
            found = []
            for a in asked:
                at = a.rpartition(" ")[2]
                found.append(f'so: {{"start_sec": {at}, "end_sec": {int(at) + 1}, "confidence": 0.9}}.' if at.isdigit() else "I can't tell")
            return found

        return answer

    rows = rendered(spark, sf_dir, "labels", "doc_id", value=_CLAIM3, human="concat('Look.. ', CAST(doc_id AS VARCHAR(20)), '..')", has_file="doc_id % 7 <> 6", duration="CASE WHEN doc_id % 5 = 4 THEN 0.0D ELSE 8.0D END")
    return annotate.tag_claims(rows, "doc_id", model, prompt="Where? {claim}").select("doc_id", "error", "human", "value")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN concat('<think>\nVideo Caption: c', doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '\nbody' END, '</think>') WHEN doc_id % 2 = 0 THEN '<think>\nVideo Caption: old\n</think>' ELSE '<think>\nbody</think>' END AS value FROM labels".replace("CASE WHEN doc_id % 2 = 0 THEN '' ELSE '\nbody' END, '</think>')", "CASE WHEN doc_id % 2 = 0 THEN '\n</think>' ELSE '\nbody</think>' END)"))
def caption_pipeline(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", value="CASE WHEN doc_id % 2 = 0 THEN '<think>\nVideo Caption: old\n</think>' ELSE '<think>\nbody</think>' END")
    captions = rendered(spark, sf_dir, "labels", "doc_id", caption="CASE WHEN quality = 1 THEN concat('c', CAST(doc_id AS VARCHAR(20))) END").where("caption is not null")
    return annotate.apply_captions(rows, captions, "doc_id")


@query("SELECT doc_id, concat('v', doc_id % 3, '#', doc_id % 4 - 1) AS name, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('v', doc_id % 3, '#', doc_id % 4 - 1) END AS picture FROM labels")
def decoded_frames(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", video="concat('v', CAST(doc_id % 3 AS VARCHAR(9)))", frame="CAST(doc_id % 4 - 1 AS INT)")
    found = rows.join(annotate.decode(rows), ["video", "frame"])
    return found.select("doc_id", F.concat("video", F.lit("#"), F.col("frame").cast("string")).alias("name"), F.col("picture").cast("string").alias("picture"))


# -- whole records ------------------------------------------------------------------------------

_ASK = "CASE WHEN doc_id % 4 = 0 THEN 'no prompt here' ELSE concat('Textual prompt: a cat ', CAST(doc_id AS VARCHAR(20)), '..\nAssess whether the video is well-aligned') END"
_QUESTION = "Judge it. Prompt: {prompt}"


def _items(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id quality toxic", h=_ASK, g=_CLAIMED)
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    return rows.withColumn("conversations", F.array(turn("human", "h"), turn("gpt", "g")))


_HUMAN_SQL = "concat('<video>\nJudge it. Prompt: ', CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('a cat ', doc_id, '.') END)"
_SEVEN_SQL = "regexp_replace(regexp_extract({0}, '<answer>(.*)</answer>', 1), 'Unsure', '')"
_V2_TEXT = (
    "concat_ws(' ', CASE WHEN vq THEN 'The video quality is good.' ELSE 'Blurred frames.' END, CASE WHEN mo THEN 'The subject movement, physical interaction, and cause-effect are all reasonable.' WHEN doc_id % 2 = 0 THEN 'It jumps.' ELSE 'Good' END, "
    "CASE WHEN pa THEN 'The video is well aligned with the prompt.' WHEN doc_id % 3 <> 0 THEN CASE WHEN NOT mo AND doc_id % 2 <> 0 THEN 'The video is not fully aligned with the prompt.' ELSE 'Good' END WHEN NOT mo AND doc_id % 2 = 0 THEN 'No cat.' ELSE 'It jumps. No cat.' END)"
)


@query(f"""
WITH s AS (SELECT *, quality = 1 AS vq, doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 <> 0 AS mo, toxic = 0 AND doc_id % 13 <> 0 AS pa, {SEVEN} AS seven FROM labels)
SELECT doc_id, {_HUMAN_SQL} AS human, concat('<think>\n', {_V2_TEXT}, '\n</think>\n<answer>\n', {_SEVEN_SQL.format('seven')}, '\n</answer>') AS gpt FROM s WHERE doc_id % 4 <> 0""")
def convert_by_texts(spark, sf_dir):
    out = rewrite.convert_records(_items(spark, sf_dir), _QUESTION, by_lines=False)
    return out.select("doc_id", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"))


@query(f"""
WITH s AS (SELECT doc_id, quality = 1 AS vq, doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS b, doc_id % 5 <> 0 AS c, toxic = 0 AS oe, doc_id % 13 = 0 AS un, {SEVEN} AS seven FROM labels),
r AS (SELECT *, CASE WHEN a THEN 'It jumps.' ELSE 'Good' END AS mr, CASE WHEN b THEN 'It jumps. No cat.' ELSE 'Good' END AS pr FROM s)
SELECT doc_id, {_HUMAN_SQL} AS human, concat('<think>\n', concat_ws('\n', CASE WHEN vq THEN 'Video Quality: Good.' ELSE 'Video Quality: Blurred frames.' END,
  CASE WHEN a OR b OR c THEN concat_ws(', ', CASE WHEN a THEN 'Subject Movement' END, CASE WHEN b THEN 'Physical Interaction' END, CASE WHEN c THEN 'Cause-Effect' END) || ': Good.' END,
  CASE WHEN NOT (a AND b AND c) THEN concat_ws(', ', CASE WHEN NOT a THEN 'Subject Movement' END, CASE WHEN NOT b THEN 'Physical Interaction' END, CASE WHEN NOT c THEN 'Cause-Effect' END) || ': ' || mr END,
  concat_ws(', ', 'Subject Existence', CASE WHEN oe THEN 'Object Existence' END, CASE WHEN NOT un THEN 'Subject-Object Interaction' END) || ': Good.', CASE WHEN NOT oe THEN 'Object Existence: ' || pr END),
  '\n</think>\n<answer>\n', {_SEVEN_SQL.format('seven')}, '\n</answer>') AS gpt FROM r""")
def convert_by_lines(spark, sf_dir):
    out = rewrite.convert_records(_items(spark, sf_dir), _QUESTION, by_lines=True)
    return out.select("doc_id", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"))


@query(f"SELECT doc_id, string_agg(k || '=' || v, ';' ORDER BY k) AS verdicts FROM (SELECT doc_id, unnest(['Video Quality','Subject Movement','Physical Interaction','Cause-Effect','Subject Existence','Object Existence','Subject-Object Interaction']) AS k, unnest(list_transform(regexp_extract_all(t, ':\\s*(Yes|No|Unsure)\\.', 1), lambda x: CASE WHEN x = 'Unsure' THEN '' ELSE x END)) AS v FROM (SELECT doc_id, {SEVEN} AS t FROM labels)) GROUP BY doc_id")
def answer_dicts(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", t=SEVEN).withColumn("m", rewrite.answer_dict(F.col("t")))
    line = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("doc_id", F.array_join(line, ";").alias("verdicts"))


_TURN2 = "CASE WHEN doc_id % 3 = 0 THEN 'system' ELSE 'gpt' END"


@query(
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('<video>\nNew task.\nPrompt: p', doc_id) ELSE 'no such word' END AS human, CASE WHEN doc_id % 3 = 0 THEN 'as it was' ELSE concat('<answer>\nVideo Quality: ', CASE WHEN doc_id % 5 = 0 THEN 'No' ELSE 'Yes' END, '. Motion & Interaction: No. Prompt Alignment: No.\n</answer>') END AS other FROM labels"
)
def merged_conversations(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", who=_TURN2, h="CASE WHEN doc_id % 2 = 0 THEN concat('Old task. Prompt: p', CAST(doc_id AS VARCHAR(20))) ELSE 'no such word' END", o="CASE WHEN doc_id % 3 = 0 THEN 'as it was' ELSE concat('<answer>Video Quality: ', CASE WHEN doc_id % 5 = 0 THEN 'No' ELSE 'Yes' END, '.</answer>') END")
    turns = F.array(F.struct(F.lit("human").alias("from"), F.col("h").alias("value")), F.struct(F.col("who").alias("from"), F.col("o").alias("value")))
    out = rows.select("doc_id", rewrite.merge_conversation(turns, "New task.").alias("c"))
    return out.select("doc_id", F.col("c")[0]["value"].alias("human"), F.col("c")[1]["value"].alias("other"))


# -- surveys with every level filled ---------------------------------------------------------------

_LEVELS = {
    "final_eval_result": "CASE WHEN event_id % 6 = 0 THEN concat('{\"has_physics_violation_issue\": \"', " + YN("event_id % 12 = 0") + ", '\", \"evidence\": \" Floats  up\", \"time_ranges\": [{\"start\": 1, \"end\": \"2.5\"}]}') END",
    "final_eval_result_raw": "CASE WHEN event_id % 4 = 0 THEN '{\"has_physics_violation_issue\": \"yes\", \"evidence\": \"Raw one\"}' END",
    "qn3": "CASE WHEN event_id % 7 = 0 THEN 'yes' WHEN event_id % 7 = 1 THEN 'No' END", "qn3_1": "CASE WHEN event_id % 3 = 0 THEN 'Arm bends' END",
    "qn3_s": "CASE WHEN event_id % 2 = 0 THEN '3' END", "qn3_e": "CASE WHEN event_id % 2 = 0 THEN '4.50' END",
    "Answer": "CASE WHEN event_id % 11 = 0 THEN '{\"dataMap\": {\"qn3\": \"no\", \"qn3_1\": \"Told within\", \"qn3_start_sec\": 5, \"qn3_end_sec\": \"6\"}}' WHEN event_id % 13 = 0 THEN '{\"data\": {\"qn3\": \"Yes\", \"qn3_start_sec\": 7, \"qn3_end_sec\": 8}}' END",
}


def _leveled(spark, sf_dir):
    video = {k: _SURVEY[k] for k in ("video_path", "video_url", "prompt_text", "first_image_url", "image_path", "source_file")}
    rows = rendered(spark, sf_dir, "events", "event_id", **video, **_LEVELS)
    return rows.withColumnsRenamed({"qn3": "[Final]qn3", "qn3_1": "[Final]qn3_1", "qn3_s": "[Final]qn3_start_sec", "qn3_e": "[Final]qn3_end_sec"})


_J = lambda c, p: f"json_extract_string({c}, '$.{p}')"
_YN = lambda x: f"CASE lower(trim({x})) WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' END"
_CL = lambda x: f"nullif(trim(regexp_replace(COALESCE({x}, ''), '\\s+', ' ', 'g')), '')"
_RT = lambda a, b: f"concat('<t>', regexp_replace({a}, '\\.?0+$', ''), 's-', regexp_replace({b}, '\\.?0+$', ''), 's</t>')"
_TAG = lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {_RT(a, b)} END"
_IN = lambda p: f"COALESCE({_J('Answer', 'dataMap.qn3' + p)}, {_J('Answer', 'data.qn3' + p)})"
_LEVEL_SQL = (
    "WITH s AS (SELECT event_id, event_id % 34 = 0 AS nov, " + ", ".join(f"{e} AS {k}" for k, e in _LEVELS.items()) + " FROM events),\n"
    f"l AS (SELECT *, COALESCE(final_eval_result, final_eval_result_raw) AS ev FROM s),\n"
)
_FLAG = "has_physics_violation_issue"
_REASON = (
    "CASE WHEN decision = 'No' THEN COALESCE(evidence, 'It obeys physics.') ELSE concat('Physics violation issue: ', COALESCE(tag || ' ', ''), COALESCE(evidence, 'There is a physics violation issue.')) END"
)
_CLOSED = "CASE WHEN right(reason, 1) = '.' THEN reason ELSE reason || '.' END"
_RANGES = lambda ev: f"CASE WHEN {_J(ev, 'time_ranges[0].start')} IS NOT NULL THEN {_RT(_J(ev, 'time_ranges[0].start'), _J(ev, 'time_ranges[0].end'))} END"


def _decided(spark, sf_dir, parts):
    rows = _leveled(spark, sf_dir).withColumns({"v": curate.video_ref(), **parts})
    return rows.where("v <> '' and decision is not null").select("event_id", "decision", "reason")


@query(_LEVEL_SQL + f"""d AS (SELECT event_id, nov, COALESCE({_YN(_J('ev', _FLAG))}, {_YN('qn3')}, {_YN(_IN(''))}) AS decision, COALESCE({_CL(_J('ev', 'evidence'))}, {_CL('qn3_1')}, {_CL(_IN('_1'))}) AS evidence,
  COALESCE({_RANGES('ev')}, {_TAG('qn3_s', 'qn3_e')}, {_TAG(_IN('_start_sec'), _IN('_end_sec'))}) AS tag FROM l), r AS (SELECT *, {_REASON} AS reason FROM d)
SELECT event_id, decision, {_CLOSED} AS reason FROM r WHERE NOT nov AND decision IS NOT NULL""")
def single_issue_three_levels(spark, sf_dir):
    return _decided(spark, sf_dir, curate.single_issue_fallbacks("physics_violation", "It obeys physics."))


@query(_LEVEL_SQL + f"""d AS (SELECT event_id, nov, COALESCE({_YN(_J('final_eval_result', _FLAG))}, {_YN('qn3')}) AS decision, COALESCE({_CL('qn3_1')}, {_CL(_J('final_eval_result', 'evidence'))}) AS evidence,
  COALESCE({_TAG('qn3_s', 'qn3_e')}, {_RANGES('final_eval_result')}) AS tag FROM l), r AS (SELECT *, {_REASON} AS reason FROM d)
SELECT event_id, decision, {_CLOSED} AS reason FROM r WHERE NOT nov AND decision IS NOT NULL""")
def single_issue_survey_first(spark, sf_dir):
    return _decided(spark, sf_dir, curate.single_issue_survey_first("physics_violation", "It obeys physics."))


@query(_LEVEL_SQL + f"""d AS (SELECT l.event_id, nov, COALESCE({_YN(_J('final_eval_result', _FLAG))}, {_YN('qn3')}) AS decision, COALESCE({_CL('qn3_1')}, {_CL(_J('final_eval_result', 'evidence'))}) AS evidence,
  COALESCE({_TAG('qn3_s', 'qn3_e')}, {_RANGES('final_eval_result')}) AS tag, user_id, event_id % 17 = 0 AS url FROM l JOIN (SELECT event_id AS i, user_id FROM events) e ON l.event_id = e.i), r AS (SELECT *, {_REASON} AS reason FROM d)
SELECT event_id, CASE WHEN url THEN concat('http://h/', user_id) ELSE concat('v/', user_id, '.mp4') END AS video, concat('<think>\n', {_CLOSED}, '\n</think>\n<answer>\n', decision, '\n</answer>') AS gpt,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('ask ', event_id) END AS prompt_text, concat('f', event_id % 4) AS source_file FROM r WHERE NOT nov AND decision IS NOT NULL""")
def single_issue_records(spark, sf_dir):
    rows = _leveled(spark, sf_dir).withColumn("source_line", F.col("event_id"))
    out = curate.single_issue_records(rows, curate.single_issue_survey_first("physics_violation", "It obeys physics."), "Is it physical?", metadata=True)
    return out.select(
        F.col("metadata.source_line").alias("event_id"), F.col("videos")[0].alias("video"), F.col("conversations")[1]["value"].alias("gpt"), "metadata.prompt_text", "metadata.source_file",
    )


_FIELDS = "concat('{', CASE WHEN event_id % 2 = 0 THEN '\"[Final]qn1_start_sec\": 1, \"[Final]qn1_end_sec\": 2' ELSE '\"x\": 0' END, CASE WHEN event_id % 3 = 0 THEN ', \"qn1_start_sec\": 5, \"qn1_end_sec\": 6.5' ELSE '' END, CASE WHEN event_id % 4 = 3 THEN ', \"[Final]qn1_start_sec\": null' ELSE '' END, '}')"


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '<t>1s-2s</t>' WHEN event_id % 4 <> 3 AND event_id % 3 = 0 THEN '<t>5s-6.5s</t>' ELSE '' END AS tag FROM events")
def field_times(spark, sf_dir):
    return rendered(spark, sf_dir, "events", "event_id", r=_FIELDS).select("event_id", text.field_time(F.col("r"), "qn1").alias("tag"))


# -- smaller operators --------------------------------------------------------------------------


@query(f"SELECT doc_id, len(v) > 0 AND len(list_filter(v, lambda x: x = 'No')) = 0 AS all_yes, contains(upper(b), 'NO') AS has_no FROM (SELECT doc_id, regexp_extract(t, '<answer>(.*)</answer>', 1) AS b, regexp_extract_all(regexp_extract(t, '<answer>(.*)</answer>', 1), ':\\s*(Yes|No)\\b', 1) AS v FROM (SELECT doc_id, {SEVEN} AS t FROM labels))")
def answer_predicates(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", t=SEVEN)
    return rows.select("doc_id", labels.all_answers_yes(F.col("t")).alias("all_yes"), labels.contains_no(text.first_tag(F.col("t"), "answer")).alias("has_no"))


@query("SELECT conv_id, turn FROM conversations WHERE turn >= 2")
def resume_after_prefix(spark, sf_dir):
    return joins.pending_after(table(spark, sf_dir, "conversations"), "turn", 2).select("conv_id", "turn")


@query("SELECT d.doc_id, d.source, l.doc_id AS other_id, l.quality FROM (SELECT doc_id, source, row_number() OVER (ORDER BY md5(text), doc_id) AS k FROM documents) d JOIN (SELECT doc_id, quality, row_number() OVER (ORDER BY quality, doc_id DESC) AS k FROM labels) l ON d.k = l.k")
def positional_zip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    others = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("other_id"), "quality", (-F.col("doc_id")).alias("back"))
    return joins.zip_in_order(docs, others, ["h", "doc_id"], ["quality", "back"]).select("doc_id", "source", "other_id", "quality")


@query("SELECT CAST(0 AS INTEGER) AS part, doc_id AS id, source, CAST(NULL AS BIGINT) AS quality FROM documents UNION ALL SELECT CAST(1 AS INTEGER), doc_id, NULL, quality FROM labels")
def plain_concat(spark, sf_dir):
    docs, marks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("quality"))
    return joins.concat(docs, marks).select(F.col("_part").alias("part"), "id", "source", "quality")


@query(f"WITH s AS (SELECT event_id, {SPANS} AS t FROM events), e AS (SELECT event_id, regexp_extract_all(t, {_TAGS}, 1) AS a, event_id % 3 = 0 AS two FROM s) SELECT event_id, CAST(COALESCE(CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN a[1] WHEN 2 THEN a[1] ELSE a[len(a)] END, '-1') AS DOUBLE) AS start_sec FROM e".replace("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN a[1] WHEN 2 THEN a[1] ELSE a[len(a)] END", "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN a[1] ELSE a[len(a)] END"))
def preceding_spans(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", t=SPANS)
    found = F.transform(text.time_spans(F.col("t")), lambda s, k: F.struct(s["start_sec"].alias("start_sec"), ((k + 1) * 10).alias("end")))
    at = F.when(F.col("event_id") % 5 == 0, 5).when(F.col("event_id") % 5 == 1, 15).otherwise(99)
    return rows.select("event_id", F.coalesce(joins.preceding_span(found, at)["start_sec"], F.lit(-1.0)).alias("start_sec"))


@query("SELECT event_id, array_to_string(list_distinct_in_order, ',') AS places FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['/abs/a.mp4'] WHEN 1 THEN ['/r/videos/videos/a.mp4', '/r/videos/a.mp4', '/here/videos/a.mp4', '/here/data/videos/a.mp4'] ELSE ['/r/videos/data/b.mp4', '/here/data/b.mp4'] END AS list_distinct_in_order FROM events)")
def video_candidate_paths(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", v="CASE event_id % 3 WHEN 0 THEN '/abs/a.mp4' WHEN 1 THEN 'videos/a.mp4' ELSE 'data/b.mp4' END")
    return rows.select("event_id", F.array_join(text.video_candidates(F.col("v"), ["/r/videos", "/here"], "/here"), ",").alias("places"))


@query(f"SELECT conv_id, CAST(21 + sum(len(list_filter(string_split_regex(COALESCE(text, ''), '{WS}+'), lambda x: x <> '')) + 5) + max((conv_id % 3 + 1) * 16 * 12 // 4) AS BIGINT) AS n_tokens FROM conversations GROUP BY conv_id")
def record_token_counts(spark, sf_dir):
    nested = records.nest(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    visual = geometry.visual_tokens(F.col("conv_id") % 3 + 1, F.lit(16), F.lit(12))
    return nested.select("conv_id", packing.token_estimate(F.col("conversations"), visual).cast("long").alias("n_tokens"))


@query("SELECT event_id, array_to_string(CASE event_id % 3 WHEN 0 THEN [0,1,2,3,4,5] WHEN 1 THEN [3,1,2] ELSE [5] END, ',') AS idx FROM events")
def bounded_index_lists(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", i="CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '3,1-2,2' ELSE '5,5' END")
    return rows.select("event_id", F.array_join(arrays.index_list(F.col("i"), F.lit(6)).cast("array<string>"), ",").alias("idx"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE [doc_id % 7, 2, 30, 40] END[1] AS x1, doc_id % 4 = 0 AS broken FROM labels")
def parsed_boxes(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", b="CASE WHEN doc_id % 4 = 0 THEN 'no box' ELSE concat('[', CAST(doc_id % 7 AS VARCHAR(9)), ',2,30,40]') END")
    return rows.select("doc_id", text.parse_box(F.col("b"))[0].cast("long").alias("x1"), text.parse_box(F.col("b")).isNull().alias("broken"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(doc_id, ':id:7') WHEN 1 THEN concat(doc_id, ':source_line:', doc_id % 5) WHEN 2 THEN concat(doc_id, ':video_url:u') ELSE 'hash' END AS key FROM labels")
def record_keys(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", m="CASE doc_id % 4 WHEN 0 THEN '{\"video_url\": \"u\", \"id\": 7}' WHEN 1 THEN concat('{\"id\": null, \"source_line\": ', CAST(doc_id % 5 AS VARCHAR(9)), '}') WHEN 2 THEN '{\"video_url\": \"u\"}' END")
    key = text.record_key(F.col("doc_id"), F.col("m"), F.lit("v").alias("videos"))
    return rows.select("doc_id", F.when(F.length(key) == 32, "hash").otherwise(key).alias("key"))


@query(f"SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '<t>.*?</t>', ' ', 'gs'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g')) AS gpt, concat('<t>1s</t> ', event_id) AS human, CAST(len(regexp_extract_all(t, '<t>.*?</t>', 0, 's')) AS INTEGER) AS n FROM (SELECT event_id, {SPANS} AS t FROM events)")
def strip_turn_tags(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", t=SPANS)
    said = F.array(F.struct(F.lit("human").alias("from"), F.concat(F.lit("<t>1s</t> "), F.col("event_id").cast("string")).alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("t").alias("value")))
    out = rows.select("event_id", text.strip_turn_tags(said).alias("r"))
    return out.select("event_id", F.col("r.conversations")[1]["value"].alias("gpt"), F.col("r.conversations")[0]["value"].alias("human"), F.col("r.n").alias("n"))


@query(f"WITH s AS (SELECT event_id, {SPANS} AS t FROM events) SELECT event_id, CAST(k AS INTEGER) AS k, CAST(a AS DOUBLE) AS start_sec, txt, CAST(least(trunc(CAST(a AS DOUBLE) * 10), 59) AS INTEGER) AS frame FROM (SELECT event_id, unnest(regexp_extract_all(t, {_TAGS}, 1)) AS a, unnest(CASE WHEN event_id % 3 = 0 THEN ['The ball floats.', 'It  falls down.'] ELSE ['The ball floats.'] END) AS txt, unnest(CASE WHEN event_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS k FROM s)")
def viz_spans(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", t=SPANS)
    each = rows.select("event_id", F.posexplode(text.viz_spans(F.col("t"), F.lit(10.0), F.lit(60))).alias("k", "s"))
    return each.select("event_id", "k", "s.start_sec", F.col("s.text").alias("txt"), "s.frame")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'It floats' ELSE '[Other]: x' END AS bare, CASE WHEN doc_id % 3 = 0 THEN 'One.Three.' ELSE 'One.' END AS clean FROM labels")
def prefixes_and_remarks(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", p="CASE WHEN doc_id % 2 = 0 THEN ' [visual quality] : It floats ' ELSE '[Other]: x' END", r="CASE WHEN doc_id % 3 = 0 THEN 'One. It is AI made! Three.' ELSE 'One. AI' END")
    return rows.select("doc_id", text.strip_label_prefix(F.col("p"), "Visual Quality").alias("bare"), text.remove_ai_sentences(F.col("r")).alias("clean"))


@query("SELECT event_id, concat('This video is uniformly sampled at ', CASE WHEN event_id % 4 = 0 THEN '2.50' ELSE printf('%.2f', 8 / 20.0) END, ' fps, contains 8 frames from 0 seconds to 20.0 seconds.') AS hint FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, '' FROM events WHERE event_id % 5 = 0")
def time_instructions(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", d="CASE WHEN event_id % 5 = 0 THEN NULL ELSE 20.0D END", r="CASE WHEN event_id % 4 = 0 THEN '2.5' WHEN event_id % 4 = 1 THEN 'x' END")
    fps = geometry.sample_fps([F.col("r")], F.lit(False), F.col("d"), F.lit(8))
    return rows.select("event_id", records.time_instruction(fps, F.lit(8), F.col("d")).alias("hint"))


@query(
    "WITH s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 40 + 1 END AS fixed, CASE WHEN event_id % 4 = 0 THEN 16 END AS cap, event_id % 50 AS src, CASE WHEN event_id % 5 <> 0 THEN 12.5 END AS dur, CASE WHEN event_id % 7 <> 0 THEN 2 END AS rate FROM events), "
    "t AS (SELECT *, COALESCE(fixed, cap, CASE WHEN dur * rate IS NOT NULL THEN greatest(1, round_even(dur * rate, 0)) END) AS taken FROM s) "
    "SELECT event_id, CAST(CASE WHEN taken IS NULL THEN src WHEN src > 0 THEN least(taken, src) ELSE taken END AS INTEGER) AS frames, round(CASE WHEN event_id % 2 = 0 THEN COALESCE(rate, 8 / dur) ELSE 8 / dur END, 6) AS fps, CAST(least(16, CASE WHEN src > 0 THEN least(src, 30) ELSE 30 END) AS INTEGER) AS capped FROM t"
)
def frame_cascade(spark, sf_dir):
    rows = rendered(
        spark, sf_dir, "events", "event_id", fixed="CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 40 + 1 AS INT) END", cap="CASE WHEN event_id % 4 = 0 THEN 16 END", src="CAST(event_id % 50 AS INT)",
        dur="CASE WHEN event_id % 5 <> 0 THEN 12.5D END", rate="CASE WHEN event_id % 7 <> 0 THEN 2.0D END",
    )
    frames = geometry.sampled_frames([F.col("fixed"), F.lit("none")], F.col("cap"), F.col("src"), F.col("dur"), F.col("rate"))
    fps = geometry.sample_fps([F.col("rate")], F.col("event_id") % 2 != 0, F.col("dur"), F.lit(8))
    return rows.select("event_id", frames.alias("frames"), F.round(fps, 6).alias("fps"), geometry.capped_frames(F.lit(16), F.array(F.col("src"), F.lit(30), F.lit(None).cast("int"))).alias("capped"))


@query("SELECT doc_id, concat('ask ', doc_id) AS first_human, CASE WHEN doc_id % 2 = 0 THEN concat('say ', doc_id) ELSE '' END AS first_gpt, CASE WHEN doc_id % 2 = 0 THEN concat('say ', doc_id) ELSE 'end' END AS second, 'end' AS last FROM labels")
def response_rules(spark, sf_dir):
    rows = rendered(spark, sf_dir, "labels", "doc_id", who="CASE WHEN doc_id % 2 = 0 THEN 'gpt' ELSE 'system' END")
    turn = lambda who, value: F.struct(who.alias("from"), value.alias("value"))
    name = F.col("doc_id").cast("string")
    some = F.when(F.col("who") == "gpt", F.array(turn(F.lit("human"), F.concat(F.lit("ask "), name)), turn(F.col("who"), F.concat(F.lit("say "), name)), turn(F.lit("system"), F.lit("end"))))
    c = F.coalesce(some, F.array(turn(F.lit("human"), F.concat(F.lit("ask "), name)), turn(F.lit("system"), F.lit("end"))))
    return rows.select("doc_id", records.required_value(c).alias("first_human"), records.response(c, "first").alias("first_gpt"), records.response(c, "second").alias("second"), records.response(c, "last").alias("last"))


_BLOCK = "CASE WHEN doc_id % 5 = 0 THEN 'plain' ELSE concat('<think> why ', CAST(doc_id AS VARCHAR(20)), ' </think>', " + SEVEN + ") END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('why ', doc_id) END AS think, CASE WHEN doc_id % 5 = 0 THEN 'Fail/Fail/Fail/Fail/Fail/Fail/Fail' ELSE array_to_string(regexp_extract_all(t, ':\\s*(Yes|No|Unsure)\\.', 1), '/') END AS verdicts FROM (SELECT doc_id, {SEVEN} AS t FROM labels)")
def trainer_answer_block(spark, sf_dir):
    said = labels.trainer_answers(F.col("t"))
    return rendered(spark, sf_dir, "labels", "doc_id", t=_BLOCK).select("doc_id", said["think"].alias("think"), F.concat_ws("/", *[said[d] for d in labels.LEGACY]).alias("verdicts"))


_S2 = rf"list_filter(string_split(regexp_replace(trim(regexp_replace(text, '{WS}+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_N2 = r"regexp_replace(regexp_replace(lower(s), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')"


@query(f"""
WITH s AS (SELECT doc_id, unnest({_S2}) AS s, generate_subscripts({_S2}, 1) AS k FROM documents),
n AS (SELECT *, {_N2} AS nrm FROM s),
f AS (SELECT doc_id, nrm, min(k) AS k, arg_min(s, k) AS s FROM n WHERE nrm <> '' GROUP BY doc_id, nrm)
SELECT n.doc_id, CAST(count(*) AS BIGINT) AS n_sentences, CAST((SELECT count(*) FROM f WHERE f.doc_id = n.doc_id) AS BIGINT) AS n_distinct, md5(COALESCE((SELECT string_agg(s, '|' ORDER BY k) FROM f WHERE f.doc_id = n.doc_id), '')) AS kept FROM n GROUP BY n.doc_id""")
def sentence_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    parts = docs.select("doc_id", text.split_sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    kept = parts.select("doc_id", F.size("s").cast("long").alias("n_sentences"), text.distinct_by_key(F.col("s")).alias("d"))
    return kept.select("doc_id", "n_sentences", F.size("d").cast("long").alias("n_distinct"), F.md5(F.array_join("d", "|").cast("binary")).alias("kept"))


# -- geometry ------------------------------------------------------------------------------------


@query(
    "WITH b AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y FROM lineitem) SELECT o, n, "
    "concat_ws(',', CAST(least(1000, round_even(x / 200 * 1000, 0)) AS INTEGER), CAST(least(1000, round_even(y / 100 * 1000, 0)) AS INTEGER), CAST(least(1000, round_even((x + 50) / 200 * 1000, 0)) AS INTEGER), CAST(least(1000, round_even((y + 30) / 100 * 1000, 0)) AS INTEGER)) AS pixels, "
    "concat_ws(',', CAST(round_even(x / 100 * 1000, 0) AS INTEGER), CAST(round_even(y / 100 * 1000, 0) AS INTEGER), 1000, 1000) AS shares, "
    "concat_ws(',', CAST(least(1000, round_even(x / 200 * 1000, 0)) AS INTEGER), CAST(least(1000, round_even(y / 100 * 1000, 0)) AS INTEGER), CAST(least(1000, round_even((x + 10) / 200 * 1000, 0)) AS INTEGER), CAST(least(1000, round_even((y + 5) / 100 * 1000, 0)) AS INTEGER)) AS mask FROM b"
)
def boxes_and_masks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o", "l_linenumber AS n", "CAST(l_partkey % 100 AS DOUBLE) AS x", "CAST(l_suppkey % 100 AS DOUBLE) AS y")
    w, h, line = F.lit(200.0), F.lit(100.0), lambda b: F.array_join(b.cast("array<string>"), ",")
    far = F.array(F.col("x"), F.col("y"), F.col("x") + 50, F.col("y") + 30)
    near = F.array(F.col("x") / 100, F.col("y") / 100, F.lit(1.5), F.lit(1.2))
    pixel = geometry.box_to_1000(F.when(F.greatest("x", "y") <= 1, F.array(far[0], far[1], far[2] + 0.0, far[3])).otherwise(far), w, h)
    mask = geometry.mask_box(F.array(F.col("x"), F.col("x") + 9), F.array(F.col("y"), F.col("y") + 4), w, h, inclusive=True)
    return rows.select("o", "n", line(pixel).alias("pixels"), line(geometry.box_to_1000(near, w, h)).alias("shares"), line(mask).alias("mask"))


@query(
    "WITH s AS (SELECT p_partkey, p_size % 5 + 1 AS n, p_size + 1 AS f FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(0, n), lambda k: CAST(trunc(k * (CAST(f - 1 AS DOUBLE) / greatest(n - 1, 1))) AS INTEGER)))), ',') AS frames, "
    "CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5 END AS number, CASE WHEN p_partkey % 3 = 1 AND p_size > 0 THEN CAST(p_size AS INTEGER) END AS whole FROM s JOIN part USING (p_partkey)"
)
def truncated_frames_and_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("-4").alias("t"))
    frames = geometry.truncated_frames(F.col("p_size") + 1, (F.col("p_size") % 5 + 1).cast("int"))
    number = F.when(F.col("p_partkey") % 3 == 0, geometry.positive_double(F.col("t")))
    return rows.select("p_partkey", F.array_join(F.array_sort(frames).cast("array<string>"), ",").alias("frames"), number.alias("number"), geometry.positive_int(F.col("t")).alias("whole"))


@query(
    "WITH s AS (SELECT p_partkey, p_size * 40 + 28 AS h, p_size * 17 + 30 AS w FROM part), b AS (SELECT *, round_even(CAST(h AS DOUBLE) / 28, 0) * 28 AS hb, round_even(CAST(w AS DOUBLE) / 28, 0) * 28 AS wb, sqrt(CAST(h AS DOUBLE) * w / 1003520) AS dn, sqrt(CAST(3136 AS DOUBLE) / (CAST(h AS DOUBLE) * w)) AS up FROM s), "
    "r AS (SELECT *, CAST(CASE WHEN hb * wb > 1003520 THEN floor(h / dn / 28) * 28 WHEN hb * wb < 3136 THEN ceil(h * up / 28) * 28 ELSE hb END AS INTEGER) AS nh, CAST(CASE WHEN hb * wb > 1003520 THEN floor(w / dn / 28) * 28 WHEN hb * wb < 3136 THEN ceil(w * up / 28) * 28 ELSE wb END AS INTEGER) AS nw FROM b) "
    "SELECT p_partkey, concat_ws(',', least(CAST(round_even(3 * (nw / CAST(w AS DOUBLE)), 0) AS INTEGER), nw - 1), least(CAST(round_even(5 * (nh / CAST(h AS DOUBLE)), 0) AS INTEGER), nh - 1), least(CAST(round_even(w * (nw / CAST(w AS DOUBLE)), 0) AS INTEGER), nw - 1), least(CAST(round_even(h * (nh / CAST(h AS DOUBLE)), 0) AS INTEGER), nh - 1)) AS box FROM r"
)
def resized_boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size * 40 + 28 AS h", "p_size * 17 + 30 AS w")
    return rows.select("p_partkey", F.array_join(geometry.resized_box(F.array(F.lit(3), F.lit(5), F.col("w"), F.col("h")), F.col("h"), F.col("w")).cast("array<string>"), ",").alias("box"))


@query(
    "WITH s AS (SELECT p_partkey, p_size % 3 + 1 AS a, p_size % 2 + 1 AS t, p_size % 4 * 2 AS h, 4 AS w FROM part), b AS (SELECT *, t * (h // 2) * (w // 2) AS n, greatest(t, h // 2, w // 2) AS jump FROM s), "
    "x AS (SELECT *, list_transform(range(0, n), lambda k: a + k // ((h // 2) * 2)) AS bt, list_transform(range(0, n), lambda k: a + k // 2 % greatest(h // 2, 1)) AS bh, list_transform(range(0, n), lambda k: a + k % 2) AS bw, CASE WHEN n = 0 THEN a ELSE a + jump END AS z FROM b) "
    "SELECT p_partkey, array_to_string(list_concat(list_concat(range(0, a), bt), range(z, z + 2)), ',') AS t, array_to_string(list_concat(list_concat(range(0, a), bh), range(z, z + 2)), ',') AS h, array_to_string(list_concat(list_concat(range(0, a), bw), range(z, z + 2)), ',') AS w FROM x"
)
def rope_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_size % 3 + 1 AS INT) AS a", "CAST(p_size % 2 + 1 AS INT) AS t_", "CAST(p_size % 4 * 2 AS INT) AS h_")
    n = (F.col("t_") * (F.col("h_") / 2) * 2).cast("int")
    ids = F.concat(F.array_repeat(F.lit(1), F.col("a")), F.array_repeat(F.lit(9), n), F.array_repeat(F.lit(2), 2))
    rows = rows.select("p_partkey", ids.alias("ids"), F.when(n > 0, F.array(F.array(F.col("t_"), F.col("h_"), F.lit(4)))).otherwise(F.array().cast("array<array<int>>")).alias("grids"))
    out = arrays.rope_ids(rows, "ids", "grids", 8, 9, 10)
    return out.select("p_partkey", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in "thw"])


# -- models -------------------------------------------------------------------------------------


@query(f"SELECT event_id, CAST(CASE WHEN event_id % 4 <> 0 THEN 4 ELSE 6 + length(t) END AS INTEGER) AS n, CAST(NULL AS VARCHAR) AS error FROM (SELECT event_id, {SPANS} AS t FROM events)")
def model_stub(spark, sf_dir):
    rows = rendered(spark, sf_dir, "events", "event_id", t=SPANS)
    return infer.generate_where(rows, labels.contains_no(text.first_tag(F.col("t"), "answer")), "t", "out", F.lit("good"), infer.echo).select("event_id", F.length("out").alias("n"), "error")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE concat('seen v/', doc_id % 4, ' ask ', doc_id) END AS out, CASE WHEN doc_id % 10 = 0 THEN 'ValueError: no video' END AS error FROM labels")
def video_requests(spark, sf_dir):
    """Requests of text and video; a batch with a bad one is tried row by row, and only that row fails."""

    def model():
        def answer(asked):
            for a in asked:
                if a["video"] is None:
                    raise ValueError("no video")
            return [f"seen {a['video']} {a['prompt']}" for a in asked]

        return answer

    rows = rendered(spark, sf_dir, "labels", "doc_id", prompt="concat('ask ', CAST(doc_id AS VARCHAR(20)))", video="CASE WHEN doc_id % 10 = 0 THEN NULL ELSE concat('v/', CAST(doc_id % 4 AS VARCHAR(9))) END")
    rows = rows.select("doc_id", F.struct("prompt", "video").alias("request"))
    return infer.generate(rows, "request", "out", model, batch=8).select("doc_id", "out", "error")


# -- files --------------------------------------------------------------------------------------


def _records(spark, sf_dir):
    nested = records.nest(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return nested.select(F.col("conv_id").cast("string").alias("id"), "conversations")


_NESTED = "SELECT CAST(conv_id AS VARCHAR) AS id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(COALESCE(text, ''), chr(10) ORDER BY turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, text)) AS said FROM conversations GROUP BY conv_id"


def _digest(rows, *keep):
    said = F.array_join(F.transform("conversations", lambda t: F.coalesce(t["value"], F.lit(""))), "\n")
    return rows.select("id", *keep, F.size("conversations").alias("n"), F.md5(said.cast("binary")).alias("said"))


@query(_NESTED)
def jsonl_round_trip(spark, sf_dir):
    path = f"{scratch(spark)}.jsonl"
    files.write_by_extension(_records(spark, sf_dir), path)
    return _digest(files.annotations(files.read_jsonl(spark, path)))


@query(_NESTED.replace("GROUP BY conv_id", "GROUP BY conv_id").replace("SELECT CAST(conv_id AS VARCHAR) AS id,", "SELECT CAST(conv_id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY CAST(conv_id AS VARCHAR)) - 1 AS BIGINT) AS idx,"))
def array_round_trip(spark, sf_dir):
    path = f"{scratch(spark)}.json"
    files.write_by_extension(_records(spark, sf_dir).orderBy("id"), path)
    return _digest(files.read_any(spark, path), F.col("_idx").alias("idx"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def tolerant_lines(spark, sf_dir):
    """Lines that are no JSON are left out, and a path that isn't there is empty."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("text").isNull(), "{broken").otherwise(F.to_json(F.struct("conv_id", "turn"))).alias("value"))
    rows.select("value").write.text(path)
    schema = "conv_id long, turn long"
    both = joins.concat(files.read_jsonl(spark, path, schema, "tolerant"), files.read_jsonl(spark, f"{path}-none", schema, "tolerant"))
    return both.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) * 2 - 1 AS INTEGER) AS line FROM (SELECT DISTINCT doc_id FROM labels)")
def numbered_lines(spark, sf_dir):
    """A blank line stands behind each record; it counts and is left out."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "labels").select("doc_id").distinct()
    rows.orderBy("doc_id").coalesce(1).select(F.explode(F.array(F.to_json(F.struct("doc_id")), F.lit(" "))).alias("value")).write.text(path)
    return files.read_numbered_jsonl(spark, path, "doc_id long").select("doc_id", "line")


@query("SELECT CAST(pack AS BIGINT) AS pack, CAST(count(*) AS BIGINT) AS n, min(id) AS first FROM (SELECT (row_number() OVER (ORDER BY CAST(conv_id AS VARCHAR)) - 1) // 3 AS pack, CAST(conv_id AS VARCHAR) AS id FROM (SELECT DISTINCT conv_id FROM conversations)) GROUP BY pack")
def packs_flattened(spark, sf_dir):
    """Packs of three records each in one array."""
    path = f"{scratch(spark)}.json"
    rows = split.positions(_records(spark, sf_dir), ["id"]).select(F.floor(F.col("_idx") / 3).alias("p"), F.struct("id", "conversations").alias("r"))
    packs = rows.groupBy("p").agg(F.array_sort(F.collect_list(F.struct(F.col("r.id").alias("id"), "r"))).alias("m")).orderBy("p")  # three of each
    write_elements(packs.select(F.to_json(F.transform("m", lambda m: m["r"])).alias("value")), path)
    return files.read_packed(spark, path, flatten=True).groupBy("pack").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query("SELECT event_type AS category, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS total, count(*) FILTER (WHERE event_id % 5 = 0) AS removed FROM events GROUP BY event_type")
def category_scan(spark, sf_dir):
    """A folder a category, in it sampled and removed records."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 == 0, "removed_scene_jumpcut.jsonl").otherwise("sampled.jsonl").alias("name"))
    files.write_categories(rows, path, "event_type", "name")
    found = files.read_categories(spark, path, "event_id long", removed=True, parts=True)
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"), F.count_if(F.contains("source_file", F.lit("removed"))).alias("removed"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'a' AS source FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'b' FROM (SELECT row_number() OVER () AS k, count(*) OVER () AS m FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE k <= CAST(floor(m * 0.5) AS BIGINT)) GROUP BY source")
def catalog_concat(spark, sf_dir):
    """One source whole, one at half its rate."""
    path = f"{scratch(spark)}.jsonl"
    files.write_by_extension(_records(spark, sf_dir), path)
    catalog = files.Catalog()
    catalog.register("one", path, "a")
    catalog.register("two", path, "b")
    return catalog.read(spark, "one,two%50").groupBy(F.col("data_path").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'merged' AS metric_schema, CAST(count(DISTINCT user_id % 3) AS INTEGER) AS dims, CAST(sum(value > 50) AS BIGINT) AS total FROM events".replace("sum(value > 50)", "count(*) FILTER (WHERE value > 50)"))
def metrics_sink(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).cast("string").alias("dim")).agg(F.count_if(F.col("value") > 50).alias("total"))
    rows = rows.unionByName(rows.agg(F.lit("overall").alias("dim"), F.sum("total").alias("total")))
    files.write_metrics(rows, "merged", path)
    back = files.read_inferred(spark, path)
    return back.select("metric_schema", F.size(F.json_object_keys(F.to_json("per_dim"))).alias("dims"), F.col("overall.total").alias("total"))


@query("SELECT doc_id, 'sound' AS place FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'problem' FROM labels WHERE quality <> 1")
def dual_sink(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("bad"))).alias("problems"))
    files.write_split(rows, f"{path}/sound", f"{path}/problem")
    back = lambda p: spark.read.schema("doc_id long").json(f"{path}/{p}").select("doc_id", F.lit(p).alias("place"))
    return back("sound").unionByName(back("problem"))


@query("SELECT doc_id, doc_id % 3 = 0 AS failed FROM (SELECT DISTINCT doc_id FROM labels)")
def restarted_stream(spark, sf_dir):
    """Results and errors of micro-batches, run twice from one checkpoint: nothing is done or told twice."""
    path = scratch(spark)
    table(spark, sf_dir, "labels").select("doc_id").distinct().write.parquet(f"{path}/in")
    step = lambda df: df.withColumn("error", F.when(F.col("doc_id") % 3 == 0, "bad"))
    for _ in range(2):
        source = spark.readStream.schema("doc_id long").parquet(f"{path}/in")
        resume.process_stream(source, step, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    good = resume.results(spark, f"{path}/out", "doc_id").select("doc_id", F.lit(False).alias("failed"))
    bad = spark.read.parquet(f"{path}/out/errors").select("doc_id", F.lit(True).alias("failed"))
    return good.unionByName(bad)


@query("SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM labels")
def cached_counts(spark, sf_dir):
    """Made once, then read."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "labels").select("doc_id")
    resume.cached(spark, path, lambda: rows)
    return resume.cached(spark, path, lambda: rows.limit(0)).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("total"))
