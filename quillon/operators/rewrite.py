"""Rewriting tagged responses: seven dimensions to three, sentence cleaning, reasoning traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.labels import GROUPS, LEGACY, MERGED, answers, format_answer, merge_for_rewriting
from quillon.functions.text import (
    clean_reasoning, ensure_sentence, first_tag, first_tag_or_null, fixed1, let, prompt_between, sentence_key, should_skip_claim,
    split_sentences, squeeze, strip, strip_interval_prefix,
)

NEW_OF = {"Video Quality": "Video Quality", **{old: new for new, olds in GROUPS.items() for old in olds}}
CLAIMS = ("Visual Quality", "Motion & Physical Consistency", "Prompt Alignment")
HEADING = r"^([A-Za-z&\- ]+(?:,\s*[A-Za-z&\- ]+)*):"


# -- seven dimensions to three -----------------------------------------------------------------


def line_dimension(line: Column) -> Column:
    """The new dimension of a reasoning line by the first of its headings that has one; null without."""
    names = F.transform(F.split(F.regexp_extract(line, HEADING, 1), ","), strip)
    mapping = F.create_map(*[F.lit(x) for kv in NEW_OF.items() for x in kv])
    new = F.filter(F.transform(names, lambda n: F.element_at(mapping, n)), lambda d: d.isNotNull())
    return F.when(line.rlike(HEADING), F.try_element_at(new, F.lit(1)))


def without_heading(line: Column) -> Column:
    return strip(F.regexp_replace(strip(line), HEADING + r"\s*", ""))


def without_good(text: Column, verdict: Column) -> Column:
    """If the verdict is No, 'Good' goes where it leads or follows white space, even at the head of a longer word."""
    s = F.regexp_replace(strip(text), r"(?i)^\s*Good\.?\s*", "")
    s = strip(squeeze(F.regexp_replace(s, r"(?i)(?<=\s)Good\.?\s*", "")))
    return F.when(verdict == "No", s).otherwise(strip(text))


def merged_labels(said: Column) -> dict[str, Column]:
    """Verdicts of the three dimensions from a map of the seven; a missing one counts as No."""
    get = lambda d: F.coalesce(F.element_at(said, d), F.lit("No"))
    return {"Video Quality": get("Video Quality"), **{new: merge_for_rewriting([get(d) for d in olds]) for new, olds in GROUPS.items()}}


def merged_think(think: Column, labels: dict[str, Column]) -> Column:
    """The lines grouped by new dimension, those without a heading under motion, cleaned and joined."""
    lines = F.filter(F.transform(F.split(think, r"\r\n|\r|\n"), strip), lambda x: x != "")
    named = F.transform(lines, lambda x: F.struct(x.alias("line"), F.coalesce(line_dimension(x), F.lit("Motion & Interaction")).alias("dim")))

    def of(pairs, dim):
        mine = F.filter(pairs, lambda p: p["dim"] == dim)
        parts = F.transform(mine, lambda p: let(without_good(without_heading(p["line"]), labels[dim]), ensure_sentence))
        text = strip(squeeze(F.array_join(F.filter(parts, lambda x: x != ""), " ")))
        return let(text, lambda t: F.when(t != "", F.concat(F.lit(f"{dim}: "), t)))

    return let(named, lambda pairs: F.concat_ws("\n", *[of(pairs, dim) for dim in MERGED]))


def merged_response(value: Column) -> Column:
    """A response without an answer is unchanged; one without a think block becomes the answer alone."""

    def write(parts, verdicts):
        labels = {d: verdicts[f"d{k}"] for k, d in enumerate(MERGED)}
        new = F.concat(F.lit("<answer>\n"), format_answer(labels), F.lit("\n</answer>"))
        full = F.concat(F.lit("<think>\n"), merged_think(parts["think"], labels), F.lit("\n</think>\n"), new)
        return F.when(parts["answer"].isNull(), parts["value"]).when(parts["think"].isNull(), new).otherwise(full)

    def of(parts):
        verdicts = let(answers(parts["answer"]), lambda said: F.struct(*[c.alias(f"d{k}") for k, c in enumerate(merged_labels(said).values())]))
        return let(verdicts, lambda v: write(parts, v))

    found = {"value": value, "answer": first_tag_or_null(value, "answer"), "think": first_tag_or_null(value, "think")}
    return let(F.struct(*[c.alias(k) for k, c in found.items()]), of)


def new_instruction(value: Column, instruction: str) -> Column:
    """A human turn with a prompt gets the new instruction before it, after its own introduction if it has one."""
    at = F.locate("Prompt:", value)
    prefix, suffix = value.substr(F.lit(1), at - 1), value.substr(at, F.length(value))
    pattern = r"(?s)^(<video>\nSuppose you are an expert.*?\n)"
    head = F.when(prefix.rlike(pattern), F.regexp_extract(prefix, pattern, 1)).otherwise("<video>\n")
    return F.when(at == 0, value).otherwise(F.concat(head, F.lit(instruction), F.lit("\n"), suffix))


def merge_conversation(conversations: Column, instruction: str) -> Column:
    def turn(t):
        value = F.when(t["from"] == "human", new_instruction(t["value"], instruction)).when(t["from"] == "gpt", merged_response(t["value"])).otherwise(t["value"])
        return F.struct(t["from"].alias("from"), value.alias("value"))

    return F.transform(conversations, turn)


# -- claims and reasoning traces ----------------------------------------------------------------


#: Fixed value: names of the claims as they are written.
CLAIM_NAMES = r"Visual Quality|Motion\s*&\s*Physical Consistency|Prompt Alignment"


def claims(think: Column, strip_intervals: bool = True) -> dict[str, Column]:
    """The three labelled claims of a think block, the last of each; '' if missing."""
    names = CLAIM_NAMES
    pattern = rf"(?s)\[({names})\]\s*:\s*(.*?)(?=\n?\[(?:{names})\]\s*:|\z)"
    k, v = (F.regexp_extract_all(think, F.lit(pattern), i) for i in (1, 2))
    pairs = F.arrays_zip(F.transform(k, lambda x: F.regexp_replace(strip(x), r"\s+", " ")).alias("k"), v.alias("v"))

    def last(name):
        found = strip(F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"])
        return F.coalesce(strip_interval_prefix(found) if strip_intervals else found, F.lit(""))

    return {name: last(name) for name in CLAIMS}


def think_with_intervals(said: dict[str, Column], intervals: Column, min_confidence: float = 0.0) -> Column:
    """Claims, one a line, with the interval of each that has a fault, no error and enough confidence.

    ``intervals``: array of (start_sec, end_sec, confidence, error) in the order of the claims, or null entries.
    """
    lines = []
    for k, name in enumerate(CLAIMS):
        claim, i = strip(said[name]), F.try_element_at(intervals, F.lit(k + 1))
        bare = i.isNull() | F.coalesce(i["error"], F.lit(False)) | (F.coalesce(i["confidence"], F.lit(0.0)) < min_confidence) | should_skip_claim(claim)
        tagged = F.concat(F.lit(f"[{name}]: <t>"), fixed1(i["start_sec"]), F.lit("s-"), fixed1(i["end_sec"]), F.lit("s</t> "), claim)
        lines.append(F.when(claim == "", f"[{name}]:").when(bare, F.concat(F.lit(f"[{name}]: "), claim)).otherwise(tagged))
    return strip(F.concat_ws("\n", *lines))


def video_eval(value: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """(claims, verdicts) of a response, keys in any case and with full-width colons too; '' where missing."""
    think, answer = first_tag(value, "think"), first_tag(value, "answer")
    names = CLAIM_NAMES
    pattern = rf"(?is)\[({names})\]\s*[:：]\s*(.*?)(?=\s*\[(?:{names})\]\s*[:：]|\z)"
    tidy = lambda x: F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"\s*&\s*", " & "), r"\s+", " ")
    k, v = (F.regexp_extract_all(think, F.lit(pattern), i) for i in (1, 2))
    pairs = F.arrays_zip(F.transform(k, tidy).alias("k"), v.alias("v"))
    last = lambda pairs, name: F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"], F.lit(""))
    said = {name: strip(last(pairs, name.lower())) for name in CLAIMS}
    marks = rf"(?i)({'|'.join(LEGACY)})\s*[:：]\s*(Yes|No)\.?"
    a, b = (F.regexp_extract_all(answer, F.lit(marks), i) for i in (1, 2))
    labels = F.arrays_zip(F.transform(a, lambda x: F.regexp_replace(F.lower(strip(x)), r"\s+", " ")).alias("k"), F.transform(b, F.initcap).alias("v"))
    return said, {d: last(labels, d.lower()) for d in LEGACY}


def _any_no(verdicts: dict[str, Column], dims) -> Column:
    out = F.lit(False)
    for d in dims:
        out = out | (verdicts[d] == "No")
    return out


def reasoning_lines(value: Column) -> Column:
    """Trace with one line per verdict group: what is good together, what is not with its shared reason.

    The stock sentences here and in ``reasoning_texts`` are fixed values.
    """
    said, verdict = video_eval(value)
    motion, prompt = GROUPS["Motion & Interaction"], GROUPS["Prompt Alignment"]
    instead = lambda text, bad, default: F.when((text == "") & bad, default).otherwise(text)
    visual = instead(clean_reasoning(said[CLAIMS[0]]), verdict["Video Quality"] == "No", "The video has noticeable visual defects.")
    reasons = {
        motion: instead(clean_reasoning(said[CLAIMS[1]]), _any_no(verdict, motion), "There are issues with motion or physical consistency."),
        prompt: instead(clean_reasoning(said[CLAIMS[2]]), _any_no(verdict, prompt), "The video is not fully aligned with the prompt."),
    }
    lines = [F.when(verdict["Video Quality"] == "Yes", "Video Quality: Good.").when(verdict["Video Quality"] == "No", F.concat(F.lit("Video Quality: "), visual))]
    for dims, why in reasons.items():
        named = lambda v, dims=dims: F.concat_ws(", ", *[F.when(verdict[d] == v, d) for d in dims])
        clean = clean_reasoning(why)
        shown = F.when(clean == "", "There are issues in this aspect.").otherwise(clean)
        lines.append(F.when(named("Yes") != "", F.concat(named("Yes"), F.lit(": Good."))))
        lines.append(F.when(named("No") != "", F.concat(named("No"), F.lit(": "), shown)))
    return F.concat_ws("\n", *lines)


def reasoning_texts(value: Column) -> dict[str, Column]:
    """Trace with one text per group, stock sentences for what is good, prompt sentences that repeat motion ones left out."""
    said, verdict = video_eval(value)
    visual, motion, prompt = (clean_reasoning(said[c]) for c in CLAIMS)
    low = F.lower(prompt)
    prompt = F.when(F.contains(low, F.lit("bad")) | F.contains(low, F.lit(" ai")), "The subject-object interaction is not well aligned with the prompt.").otherwise(prompt)
    fallback = lambda text, default: F.when(text == "", default).otherwise(text)

    def all_yes(dims):
        out = F.lit(True)
        for d in dims:
            out = out & (verdict[d] == "Yes")
        return out

    visual = F.when(verdict["Video Quality"] == "Yes", "The video quality is good.").otherwise(fallback(visual, "The video has noticeable visual defects."))
    motion = F.when(all_yes(GROUPS["Motion & Interaction"]), "The subject movement, physical interaction, and cause-effect are all reasonable.").otherwise(
        fallback(motion, "There are issues with motion, physical interaction, or cause-effect consistency.")
    )
    misaligned = "The video is not fully aligned with the prompt."
    prompt = F.when(all_yes(GROUPS["Prompt Alignment"]), "The video is well aligned with the prompt.").otherwise(fallback(prompt, misaligned))
    told = F.transform(split_sentences(motion), sentence_key)
    rest = F.array_join(F.filter(split_sentences(prompt), lambda s: ~F.array_contains(told, sentence_key(s))), " ")
    return {"visual": visual, "motion": motion, "prompt": fallback(rest, misaligned)}


def rewritten_response(value: Column) -> Column:
    """The trace by lines and the seven verdicts, missing ones left blank."""
    verdict = video_eval(value)[1]
    return F.concat(F.lit("<think>\n"), reasoning_lines(value), F.lit("\n</think>\n<answer>\n"), format_answer(verdict), F.lit("\n</answer>"))


def traced_response(value: Column) -> Column:
    """The trace by texts, on one line, and the seven verdicts, missing ones left blank."""
    verdict = video_eval(value)[1]
    return F.concat(F.lit("<think>\n"), F.concat_ws(" ", *reasoning_texts(value).values()), F.lit("\n</think>\n<answer>\n"), format_answer(verdict), F.lit("\n</answer>"))


def answer_dict(value: Column) -> Column:
    """The seven verdicts as a map, missing ones ''."""
    return F.create_map(*[x for d, v in video_eval(value)[1].items() for x in (F.lit(d), v)])


def convert_records(records: DataFrame, question: str, by_lines: bool) -> DataFrame:
    """Whole records rewritten: ``question`` with the prompt of the human turn in place of ``{prompt}``, and a new response.

    With a trace by lines a record without a prompt gets an empty one; with one by texts it is left out.
    """
    human, gpt = (F.try_element_at("conversations", F.lit(k))["value"] for k in (1, 2))
    asked = records.withColumns({"_prompt": textual_prompt(human), "_gpt": rewritten_response(gpt) if by_lines else traced_response(gpt)})
    if not by_lines:
        asked = asked.where("_prompt is not null")
    said = F.concat(F.lit("<video>\n"), F.replace(F.lit(question), F.lit("{prompt}"), F.coalesce("_prompt", F.lit(""))))
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    return asked.withColumn("conversations", F.array(turn("human", said), turn("gpt", F.col("_gpt")))).drop("_prompt", "_gpt")


def textual_prompt(human: Column) -> Column:
    """The prompt of a human turn with doubled stops made single; null if it has none."""
    return F.replace(prompt_between(human), F.lit(".."), F.lit("."))
