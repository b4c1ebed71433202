"""Verdict labels: normalising, parsing and merging them.

The scorer's and the trainer's rules differ, as do the two ways to merge seven verdicts into three;
they are kept apart under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import all_tags, first_tag, has_tag, let, strip

# The dimensions of the three schemas, their aliases and groups.
MERGED = ("Video Quality", "Motion & Interaction", "Prompt Alignment")
LEGACY = (
    "Video Quality", "Subject Movement", "Physical Interaction", "Cause-Effect", "Subject Existence", "Object Existence",
    "Subject-Object Interaction",
)
SINGLE = ("Answer",)
GROUPS = {
    "Motion & Interaction": ("Subject Movement", "Physical Interaction", "Cause-Effect"),
    "Prompt Alignment": ("Subject Existence", "Object Existence", "Subject-Object Interaction"),
}
ALIASES = {
    "Video Quality": ("Video Quality", "Visual Quality"),
    "Motion & Interaction": (
        "Motion & Interaction", "Motion and Interaction", "Motion & Physical Consistency", "Motion and Physical Consistency",
    ),
}
SCHEMAS = {"merged": MERGED, "legacy": LEGACY, "single_issue": SINGLE}
# Words that the trainer takes for yes and for no.
TRAINER_YES = ("yes", "good", "true", "correct", "present", "exists", "aligned", "match", "matched", "plausible")
TRAINER_NO = ("no", "bad", "false", "incorrect", "absent", "missing", "misaligned", "mismatch", "implausible")
#: Model families by the first keyword that a name holds, in this order.
FAMILIES = (
    ("internvl", "internvl"), ("molmo", "molmo2"), ("gemma", "gemma4"), ("minicpm", "minicpmv"), ("qwen2.5", "qwen2.5vl"),
    ("qwen2_5", "qwen2.5vl"), ("qwen2", "qwen2vl"),
)


def yes_no(c: Column) -> Column:
    """Yes, No or null."""
    bare = F.lower(strip(c.cast("string")))
    return F.when(bare == "yes", "Yes").when(bare == "no", "No")


def scorer_label(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(strip(c)), r"(?U)[^\w]", "")
    return F.when(bare.isin("yes", "y", "true", "1", "good"), "yes").when(bare.isin("no", "n", "false", "0", "bad"), "no").otherwise("fail")


def trainer_label(c: Column) -> Column:
    """The first word by larger sets of synonyms; an unknown word stands for itself."""
    bare = F.rtrim(F.rtrim(F.lower(strip(c)), F.lit("。")), F.lit("."))
    word = F.split(bare, r"(?U)[\s,;:]+")[0]
    return F.when(word.isin(*TRAINER_YES), "yes").when(word.isin(*TRAINER_NO), "no").when(word != "", word).otherwise("fail")


def single_issue_label(c: Column) -> Column:
    plain, hits = scorer_label(c), F.regexp_extract_all(c, F.lit(r"(?iU)\b(yes|no)\b"), 1)
    return F.when(plain != "fail", plain).when(F.size(hits) == 1, F.lower(hits[0])).otherwise("fail")


def keyed_words(c: Column, keys: tuple[str, ...]) -> Column:
    """(key in lower case, word behind its colon) wherever a key or an alias of it stands, in one search."""
    names = "|".join(rf"\Q{a}\E" for key in keys for a in ALIASES.get(key, (key,)))
    pattern = F.lit(rf"(?iU)({names})\s*\]?\s*[:：](?=\s*([A-Za-z]+))")
    found = F.arrays_zip(F.regexp_extract_all(c, pattern, 1).alias("key"), F.regexp_extract_all(c, pattern, 2).alias("word"))
    return F.transform(found, lambda p: F.struct(F.lower(p["key"]).alias("key"), p["word"].alias("word")))


def keyed_label(words: Column, key: str) -> Column:
    """The label of a key among ``keyed_words``, that of its first place."""
    mine = F.filter(words, lambda p: p["key"].isin(*[a.lower() for a in ALIASES.get(key, (key,))]))
    return F.coalesce(scorer_label(F.try_element_at(mine, F.lit(1))["word"]), F.lit("fail"))


def merge_for_scoring(labels: list[Column]) -> Column:
    """Yes if all are, no if any is, else fail."""
    all_yes, any_no = labels[0] == "yes", labels[0] == "no"
    for x in labels[1:]:
        all_yes, any_no = all_yes & (x == "yes"), any_no | (x == "no")
    return F.when(all_yes, "yes").when(any_no, "no").otherwise("fail")


def merge_for_rewriting(labels: list[Column]) -> Column:
    """Yes if all are Yes, else No; a missing one is No."""
    every = F.coalesce(labels[0] == "Yes", F.lit(False))
    for x in labels[1:]:
        every = every & F.coalesce(x == "Yes", F.lit(False))
    return F.when(every, "Yes").otherwise("No")


def answer_body(c: Column) -> Column:
    """The inside of the answer tag, closed or not, else the whole text."""
    c = F.coalesce(c, F.lit(""))
    pattern = r"(?isU)<answer>\s*(.*?)\s*(?:</answer>|\z)"
    return F.when(c.rlike(r"(?i)<answer>"), strip(F.regexp_extract(c, pattern, 1))).otherwise(strip(c))


def parse_verdicts(c: Column, schema: str) -> dict[str, Column]:
    """The label of each dimension; merged ones that fail fall back to the seven older ones."""
    if schema == "single_issue":
        return {"Answer": let(answer_body(c), single_issue_label)}
    old = dict.fromkeys(k for keys in GROUPS.values() for k in keys) if schema == "merged" else {}
    every = (*SCHEMAS[schema], *old)
    told = let(keyed_words(answer_body(c), every), lambda words: F.struct(*[keyed_label(words, k).alias(f"d{i}") for i, k in enumerate(every)]))

    def settle(label):
        found = {key: label[f"d{i}"] for i, key in enumerate(every)}
        new = {key: found[key] for key in SCHEMAS[schema]}
        if schema == "merged":
            new |= {key: F.when(new[key] == "fail", merge_for_scoring([found[k] for k in keys])).otherwise(new[key]) for key, keys in GROUPS.items()}
        return F.struct(*[x.alias(f"d{i}") for i, x in enumerate(new.values())])

    done = let(told, settle)
    return {key: done[f"d{i}"] for i, key in enumerate(SCHEMAS[schema])}


def trainer_answers(c: Column) -> dict[str, Column]:
    """Think content and, per older dimension, the raw verdict up to the next key; Fail if there is none."""
    body = all_tags(F.coalesce(c, F.lit("")), "answer")[0]
    union = "|".join(rf"\Q{k}\E" for k in LEGACY)
    out = {"think": all_tags(F.coalesce(c, F.lit("")), "think")[0]}
    for key in LEGACY:
        pattern = rf"(?isU)\Q{key}\E\s*:\s*(.*?)\s*(?=(?:{union})\s*:|</answer>|\z)"
        value = strip(F.rtrim(strip(F.regexp_replace(strip(F.regexp_extract(body, pattern, 1)), r"(?i)</answer>\s*\z", "")), F.lit(".")))
        out[key] = F.when(value != "", value).otherwise("Fail")
    return out


def answer_is_yes(c: Column) -> Column:
    """The first closed answer says exactly yes."""
    return F.coalesce(F.lower(F.regexp_replace(first_tag(c, "answer"), r"(?U)\s+", " ")) == "yes", F.lit(False))


def all_answers_yes(c: Column) -> Column:
    said = F.regexp_extract_all(first_tag(c, "answer"), F.lit(r"(?i):\s*(Yes|No)\b"), 1)
    return (F.size(said) > 0) & F.forall(said, lambda x: F.lower(x) == "yes")


def contains_no(c: Column) -> Column:
    """NO stands anywhere in the upper-cased answer."""
    return F.contains(F.upper(c), F.lit("NO"))


def answers(c: Column, ignore_case: bool = False) -> Column:
    """Dimension to verdict, the last of each winning."""
    keys, labels = ("([A-Za-z&\\- ]+):\\s*(Yes|No)", 1), ("([A-Za-z&\\- ]+):\\s*(Yes|No)", 2)
    if ignore_case:
        keys, labels = ("(?i)([A-Za-z&\\-\\s]+):\\s*(Yes|No)", 1), ("(?i)([A-Za-z&\\-\\s]+):\\s*(Yes|No)", 2)
    k = F.transform(F.regexp_extract_all(c, F.lit(keys[0]), keys[1]), strip)
    v = F.transform(F.regexp_extract_all(c, F.lit(labels[0]), labels[1]), lambda x: F.initcap(x) if ignore_case else x)
    pairs = F.arrays_zip(k.alias("k"), v.alias("v"))
    last = lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"])
    return F.map_from_entries(F.filter(pairs, last))


def format_answer(labels: dict[str, Column]) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}: "), v, F.lit(".")) for k, v in labels.items()])


def ordered_answer(c: Column) -> Column:
    """The seven verdicts in fixed order; null unless all seven keys are there."""
    said = answers(c, ignore_case=True)
    line = format_answer({k: F.coalesce(F.element_at(said, k), F.lit("Failed")) for k in LEGACY})
    return F.when(F.size(said) == 7, line)


def split_label(conversations: Column) -> Column:
    """The answer of the last turn, its white space collapsed; UNKNOWN without one or with a single turn."""
    told = lambda last: F.when(has_tag(last, "answer"), F.regexp_replace(first_tag(last, "answer"), r"(?U)\s+", " "))
    found = let(F.when(F.size(conversations) >= 2, F.try_element_at(conversations, F.lit(-1))["value"]), told)
    return F.coalesce(found, F.lit("UNKNOWN"))


def model_family(c: Column) -> Column:
    low, out = F.lower(c), F.lit("qwen3vl")
    for keyword, family in reversed(FAMILIES):
        out = F.when(F.contains(low, F.lit(keyword)), family).otherwise(out)
    return out


def metric_schema(c: Column) -> Column:
    """The schema a name stands for; anything else is the merged one."""
    return F.when(c.isin("single_issue", "legacy"), c).otherwise("merged")
