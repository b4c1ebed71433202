"""Tagged text as Column expressions: white space, tags, times, sentences, JSON in strings.

Python's ``\\s`` and ``\\w`` know Unicode, so patterns carry ``(?U)``. Everything here is a built-in or
higher-order expression; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.geometry import frame_index

# Bare ends of evidence, tags of time ranges.
EDGE = " .,:;\"'"
RANGE_TAG = r"(?i)<t>\s*([0-9]+(?:\.[0-9]+)?)s\s*-\s*([0-9]+(?:\.[0-9]+)?)s\s*</t>"
PLAIN_RANGE = r"<t>([0-9.]+)s-([0-9.]+)s</t>"


def _rx(pattern: str) -> Column:
    return F.lit(pattern)


def let(value: Column, then) -> Column:
    """``then`` of a value that is named once, so that a long expression is neither copied nor evaluated again."""
    return F.element_at(F.transform(F.array(value), lambda v: then(v)), 1)


# -- white space and sentences ---------------------------------------------------------------


def strip(c: Column) -> Column:
    """All white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def clean_text(c: Column) -> Column:
    """Null is empty; runs of white space are one space; ends are bare."""
    return strip(squeeze(F.coalesce(c.cast("string"), F.lit(""))))


def ensure_sentence(c: Column) -> Column:
    """Closed by a full stop unless closed already; empty stays empty."""
    bare = strip(c)
    return F.when((bare == "") | bare.rlike("[.!?。！？]\\z"), bare).otherwise(F.concat(bare, F.lit(".")))


def words(c: Column) -> Column:
    """Words between white space; the empty text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def limit_words(c: Column, n: int) -> Column:
    """The first n words; the text itself when it has no more, or when n is not positive."""
    if n <= 0:
        return c
    w = words(c)
    return F.when(F.size(w) <= n, c).otherwise(F.array_join(F.slice(w, 1, n), " "))


def split_sentences(c: Column) -> Column:
    whole = strip(squeeze(c))
    parts = F.transform(F.split(whole, r"(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: s != "")


def sentence_key(c: Column) -> Column:
    """What tells sentences apart: lower-cased ASCII letters, digits and single spaces."""
    return squeeze(F.regexp_replace(strip(F.lower(c)), r"(?U)[^a-z0-9\s]", ""))


def mentions_machine(c: Column) -> Column:
    """A remark about the video being machine-made, or the writer's belief."""
    return strip(F.lower(c)).rlike(r"\bai-generated\b|\bai generated\b|\bi believe\b")


def distinct_by_key(sentences: Column) -> Column:
    """Sentences with a key, the first of each key kept, in order.

    Ordered by a hash of the key, which nearly always decides, then by the key itself; sentences are taken by their places at the end.
    """

    def kept(whole):
        def hashed(key, i):
            return F.struct(F.xxhash64(key).alias("h"), key.alias("k"), i.alias("i"))

        keyed = F.transform(whole, lambda s, i: let(sentence_key(s), lambda key: hashed(key, i)))

        def firsts(by_key):
            mine = F.filter(by_key, lambda p, i: (p["k"] != "") & ((i == 0) | (F.get(by_key, i - 1)["k"] != p["k"])))
            return F.transform(F.sort_array(F.transform(mine, lambda p: p["i"])), lambda i: strip(F.get(whole, i)))

        return let(F.sort_array(keyed), firsts)

    return let(sentences, kept)


def clean_reasoning(c: Column) -> Column:
    """Distinct sentences without remarks about machines, as one line."""
    return F.array_join(distinct_by_key(F.filter(split_sentences(c), lambda s: ~mentions_machine(s))), " ")


def sentence_after(c: Column) -> Column:
    """The first sentence, or line, of a text up to the next tag."""
    tail = strip(F.regexp_extract(strip(c), r"^([^<]*)", 1))
    found = F.regexp_extract(tail, r"(?U)(.+?[。！？.!?])(?:\s|\z)", 1)
    return strip(F.when(found != "", found).otherwise(F.regexp_extract(tail, r"^([^\n\r]*)", 1)))


def first_sentence(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?U)(.+?[。！？.!?])(?:\s|\z)", 1)
    line = F.regexp_extract(c, r"^([^\n\r]*)", 1)
    return F.btrim(F.when(found != "", found).otherwise(line), F.lit(EDGE))


def remove_ai_sentences(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?i)[^.!?]*\bAI\b[^.!?]*[.!?]?\s*", ""))


# -- tags ------------------------------------------------------------------------------------


def has_tag(c: Column, tag: str, ignore_case: bool = True) -> Column:
    return c.rlike(rf"(?s{'i' if ignore_case else ''})<{tag}>.*?</{tag}>")


def first_tag(c: Column, tag: str, ignore_case: bool = True) -> Column:
    """Bare content of the first pair of tags; '' if there is none."""
    return strip(F.regexp_extract(c, rf"(?Us{'i' if ignore_case else ''})<{tag}>\s*(.*?)\s*</{tag}>", 1))


def first_tag_or_null(c: Column, tag: str, ignore_case: bool = False) -> Column:
    return F.when(has_tag(c, tag, ignore_case), first_tag(c, tag, ignore_case))


def all_tags(c: Column, tag: str) -> Column:
    """Contents of all pairs; one empty string if there are none."""
    found = F.transform(F.regexp_extract_all(c, _rx(rf"(?Uis)<{tag}>\s*(.*?)\s*</{tag}>"), 1), strip)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def _between(c: Column, tag: str):
    begin, end = F.locate(f"<{tag}>", c), F.locate(f"</{tag}>", c)
    return begin, end, (begin > 0) & (end > begin)


def found_tag(c: Column, tag: str, fallback: Column) -> Column:
    """Content from the first opening tag to the first closing one if that comes later."""
    begin, end, ok = _between(c, tag)
    at = begin + len(tag) + 2
    return F.when(ok, strip(c.substr(at, end - at))).otherwise(fallback)


def replace_tag(c: Column, tag: str, new: Column) -> Column:
    begin, end, ok = _between(c, tag)
    head, tail = c.substr(F.lit(1), begin + len(tag) + 1), c.substr(end, F.length(c))
    return F.when(ok, F.concat(head, F.lit("\n"), new, F.lit("\n"), tail)).otherwise(c)


def strip_think(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


def trim_repeated_response(c: Column) -> Column:
    """Cut after the answer's end, else after the turn's, else after the text's: in that order, wherever they stand."""
    out = strip(c)
    for mark in ("</s>", "<|im_end|>", "</answer>"):
        at = F.locate(mark, c)
        out = F.when(at > 0, strip(c.substr(F.lit(1), at + len(mark) - 1))).otherwise(out)
    return out


# -- times -----------------------------------------------------------------------------------


def fixed1(x: Column) -> Column:
    """One decimal, ties by the exact binary value, no thousands separators."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def format_second(c: Column) -> Column:
    """A number or its text with at most one decimal; null if it is none."""
    number = c.cast("string").try_cast("double")
    return F.regexp_replace(F.regexp_replace(fixed1(number), r"0+\z", ""), r"\.\z", "")


def range_tag(start: Column, end: Column) -> Column:
    """A tag of two seconds; null if either is missing."""
    a, b = format_second(start), format_second(end)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit("<t>"), a, F.lit("s-"), b, F.lit("s</t>")))


def range_tags(ranges: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Tags of an array of (start, end), or of the fallback pair if that leaves none."""
    tags = F.filter(F.transform(F.coalesce(ranges, F.array().cast("array<struct<start:string,end:string>>")), lambda r: range_tag(r["start"], r["end"])), lambda t: t.isNotNull())
    joined = F.array_join(tags, " ")
    if start is None:
        return joined
    return F.when(F.size(tags) > 0, joined).otherwise(F.coalesce(range_tag(start, end), F.lit("")))


def time_tag_score(c: Column) -> Column:
    """Seconds covered by all range tags, backward ones counting nothing."""
    a, b = (F.regexp_extract_all(c, _rx(PLAIN_RANGE), k) for k in (1, 2))
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    length = lambda p: F.coalesce(F.greatest(F.lit(0.0), p["b"].try_cast("double") - p["a"].try_cast("double")), F.lit(0.0))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + length(p))


TIME_TAG = r"(?s)<t>.*?</t>"


def strip_time_tags(c: Column) -> Column:
    """Time tags out, the blanks they leave squeezed; texts without tags unchanged."""
    gone = F.regexp_replace(F.regexp_replace(c, TIME_TAG, " "), r"[ \t]+", " ")
    return F.when(time_tag_count(c) > 0, strip(F.regexp_replace(gone, r" *\n *", "\n"))).otherwise(c)


def strip_turn_tags(conversations: Column) -> Column:
    """(conversations, n): the model's turns without time tags, and how many tags there were."""
    mine = F.filter(conversations, lambda t: t["from"] == "gpt")
    n = F.aggregate(F.transform(mine, lambda t: F.coalesce(time_tag_count(t["value"]), F.lit(0))), F.lit(0), lambda a, x: a + x)
    turn = lambda t: F.struct(t["from"].alias("from"), F.when(t["from"] == "gpt", strip_time_tags(t["value"])).otherwise(t["value"]).alias("value"))
    return F.struct(F.transform(conversations, turn).alias("conversations"), n.alias("n"))


def time_tag_count(c: Column) -> Column:
    return F.regexp_count(c, _rx(TIME_TAG))


def point_tags(c: Column) -> Column:
    """Each range tag as two points of one decimal."""
    a, b = (F.regexp_extract_all(c, _rx(RANGE_TAG), k) for k in (1, 2))
    point = lambda x, end: F.concat(F.lit("<t>"), fixed1(x.cast("double")), F.lit(end))
    points = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.concat(point(p["a"], "s</t> to "), point(p["b"], "s</t>")))
    return F.array_join(_weave(F.split(c, RANGE_TAG), points), "")


def _weave(texts: Column, marks: Column) -> Column:
    """Texts with the marks between them."""
    return F.flatten(F.transform(F.arrays_zip(texts.alias("x"), marks.alias("y")), lambda p: F.array(p["x"], F.coalesce(p["y"], F.lit("")))))


def strip_interval_prefix(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"^<t>\d+(\.\d+)?s-\d+(\.\d+)?s</t>\s*", ""))


def remove_t_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<t>\d+(\.\d+)?s-\d+(\.\d+)?s</t>", "")


def strip_label_prefix(c: Column, label: str) -> Column:
    return strip(F.regexp_replace(strip(c), rf"(?i)^\[\Q{label}\E\]\s*:\s*", ""))


def should_skip_claim(c: Column) -> Column:
    return F.contains(strip(squeeze(F.lower(remove_t_tags(c)))), F.lit("good"))


def time_spans(c: Column) -> Column:
    """(start_sec, end_sec, evidence) of each range tag in each think block; evidence runs to the next tag or the block's end."""
    blocks = F.regexp_extract_all(c, _rx(r"(?is)<think>(.*?)</think>"), 1)

    def of(block):
        a, b = (F.regexp_extract_all(block, _rx(RANGE_TAG), k) for k in (1, 2))
        after = F.slice(F.split(block, RANGE_TAG), 2, F.greatest(F.size(a), F.lit(1)))
        zipped = F.arrays_zip(a.alias("a"), b.alias("b"), after.alias("e"))
        spans = F.transform(zipped, lambda z: F.struct(z["a"].cast("double").alias("start_sec"), z["b"].cast("double").alias("end_sec"), z["e"].alias("evidence")))
        return F.when(F.size(a) > 0, spans).otherwise(F.slice(spans, 1, 0))

    return F.flatten(F.transform(blocks, of))


def tag_slots(c: Column) -> Column:
    """Every range tag of a text in order: the tag, and whether it stands in a closed think block."""

    def of(pieces):
        mark = lambda p: F.lower(F.regexp_extract(p, r"(?is).*(</?think>)", 1))
        opens = F.transform(pieces, mark)

        def inside(k):
            last = F.try_element_at(F.filter(F.slice(opens, 1, k + 1), lambda m: m != ""), F.lit(-1))
            closed = F.exists(F.slice(pieces, k + 2, F.size(pieces)), lambda p: p.rlike("(?i)</think>"))
            return F.coalesce(last == "<think>", F.lit(False)) & closed

        return F.transform(F.regexp_extract_all(c, _rx(RANGE_TAG), 0), lambda t, k: F.struct(t.alias("tag"), inside(k).alias("inside")))

    return let(F.split(c, RANGE_TAG), of)


def annotate_tags(c: Column, notes: Column) -> Column:
    """The k-th range tag within think blocks replaced by the k-th note; a null note leaves it."""

    def put(slots):
        nth = lambda k: F.size(F.filter(F.slice(slots, 1, k + 1), lambda s: s["inside"]))
        marks = F.transform(slots, lambda s, k: F.when(s["inside"], F.coalesce(F.get(notes, nth(k) - 1), s["tag"])).otherwise(s["tag"]))
        return F.array_join(_weave(F.split(c, RANGE_TAG), marks), "")

    return let(tag_slots(c), put)


def viz_spans(c: Column, fps: Column, frames: Column) -> Column:
    """(start_sec, end_sec, text, frame) of each range tag: the sentence behind it and the frame it starts at."""
    a, b = (F.regexp_extract_all(c, _rx(RANGE_TAG), k) for k in (1, 2))
    after = F.slice(F.split(c, RANGE_TAG), 2, F.greatest(F.size(a), F.lit(1)))

    def span(z):
        start = z["a"].cast("double")
        return F.struct(start.alias("start_sec"), z["b"].cast("double").alias("end_sec"), sentence_after(z["e"]).alias("text"), frame_index(start, fps, frames).alias("frame"))

    spans = F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), after.alias("e")), span)
    return F.when(F.size(a) > 0, spans).otherwise(F.slice(spans, 1, 0))


def format_seconds(x: Column) -> Column:
    """Whole seconds without decimals, others with one."""
    near = F.abs(x - F.bround(x)) < 1e-6
    return F.concat(F.when(near, F.bround(x).cast("long").cast("string")).otherwise(fixed1(x)), F.lit("s"))


def format_box(box: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(box.cast("array<string>"), ","), F.lit("]"))


def time_annotation(start: Column, end: Column, start_box: Column, end_box: Column) -> Column:
    point = lambda t, b: F.concat(F.lit("<t>"), format_seconds(t), F.lit("</t>"), F.coalesce(F.concat(F.lit("<box>"), format_box(b), F.lit("</box>")), F.lit("")))
    return F.concat(point(start, start_box), F.lit(" to "), point(end, end_box))


def apply_replacements(c: Column, replacements: Column) -> Column:
    """Splice (begin, end, text), offsets from 0, from the right so that earlier offsets hold."""
    order = F.reverse(F.array_sort(replacements))
    return F.aggregate(order, c, lambda s, r: F.concat(s.substr(F.lit(1), r["begin"]), r["text"], s.substr(r["end"] + 1, F.length(s))))


# -- evidence and objects --------------------------------------------------------------------

#: Prompts that name no object.
BAD_PROMPTS = (
    "scene", "the scene", "issue", "violation", "motion", "movement", "movements", "expressions", "interaction",
    "interactions", "physics", "physical laws",
)
#: Verbs that end the naming of an object.
STOP_VERBS = (
    "suddenly|stands?|moves?|moving|releases?|floats?|floating|rises?|rising|"
    "falls?|falling|disconnects?|disappears?|appears?|remains?|shakes?|shaking|"
    "deforms?|changes?|rotates?|slides?|jumps?|flies?|flying|levitates?|"
    "will|would|does|do|did|can|is|are|was|were|looks?|seems?|becomes?|"
    "unzipped?|opens?|closes?|turns?|transforms?|interacts?"
)
#: Fixed value: headings of evidence.
EVIDENCE_PREFIX = r"(?is)^\s*(?:video caption\s*:\s*.*?(?:\n|\z))*(?:physics violation issue|issue|violation|evidence)\s*:\s*"


def evidence_key(c: Column) -> Column:
    s = F.regexp_replace(strip(F.lower(c)), r"<t>.*?</t>", " ")
    return F.btrim(F.regexp_replace(s, r"[^a-z0-9]+", " "))


def clean_evidence(c: Column) -> Column:
    s = F.regexp_replace(c, r"(?is)<box>.*?</box>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"<[^>]+>", " "), EVIDENCE_PREFIX, "")
    return F.btrim(squeeze(s), F.lit(EDGE))


#: What is taken off a named object, and where an object is named in a sentence.
LEADING_ARTICLE = r"(?i)^(?:the|a|an|this|that)\s+"
TRAILING_PRONOUN = r"(?i)\b(?:that|which|who)$"
POSSESSIVE = r"'s\b.*$"
SECOND_OF_TWO = r"(?i)\bbetween\s+(.+?)\s+and\s+(.+?)(?:[.,;]|$)"
SUBJECT_WITH_ARTICLE = rf"(?i)^(?:the|a|an|this|that)\s+(.+?)\s+\b({STOP_VERBS})\b"
SUBJECT = rf"(?is)^(.*?)\b({STOP_VERBS})\b"


def object_prompt(c: Column, max_words: int) -> Column:
    """A bare noun phrase of at most max_words words; null if it names nothing."""
    return let(_bare_object(c, max_words), _named)


def _bare_object(c: Column, max_words: int) -> Column:
    p = squeeze(F.btrim(c, F.lit(EDGE)))
    p = F.regexp_replace(p, LEADING_ARTICLE, "")
    p = strip(F.regexp_replace(p, TRAILING_PRONOUN, ""))
    p = F.btrim(strip(F.regexp_replace(p, POSSESSIVE, "")), F.lit(EDGE))
    return let(p, lambda q: limit_words(q, max_words))


def _named(p: Column) -> Column:
    low = F.lower(p)
    bad = low.isin(*BAD_PROMPTS) | F.exists(F.array(*map(F.lit, BAD_PROMPTS)), lambda b: F.startswith(low, F.concat(b, F.lit(" "))))
    return F.when((p != "") & ~bad, p)


def heuristic_object_prompt(c: Column, max_words: int) -> Column:
    """The second of two things between which something happens, else what stands before a verb, else the sentence."""
    return let(let(clean_evidence(c), first_sentence), lambda text: _heuristic(text, max_words))


def _heuristic(text: Column, max_words: int) -> Column:
    taken = lambda pattern, k: F.when(text.rlike(pattern), object_prompt(F.regexp_extract(text, pattern, k), max_words))
    return F.when(
        text != "",
        F.coalesce(
            taken(SECOND_OF_TWO, 2),
            taken(SUBJECT_WITH_ARTICLE, 1),
            taken(SUBJECT, 1),
            object_prompt(text, max_words),
        ),
    )


# -- JSON, keys, paths -----------------------------------------------------------------------


def json_object(c: Column) -> Column:
    """The text if it holds a JSON object, else null."""
    parsed = F.try_parse_json(c)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), c)


def loose_json(c: Column) -> Column:
    """The text if it is JSON, else its longest braced part if that is, else null."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(c).isNotNull(), c).when(F.try_parse_json(inner).isNotNull(), inner)


def content_key(*columns: Column) -> Column:
    """Hash of the canonical JSON of the columns: equal for equal records."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"))


def record_key(index: Column, metadata: Column, *content: Column) -> Column:
    """'index:name:value' by the first of id, source_line and video_url that the metadata (JSON) has, else a hash of index and content."""
    named = [F.concat_ws(":", index.cast("string"), F.lit(k), v) for k in ("id", "source_line", "video_url") for v in [F.get_json_object(metadata, f"$.{k}")]]
    have = [F.when(F.get_json_object(metadata, f"$.{k}").isNotNull(), n) for k, n in zip(("id", "source_line", "video_url"), named)]
    return F.coalesce(*have, content_key(index.alias("index"), *content))


def parse_box(c: Column) -> Column:
    """'[x1,y1,x2,y2]' as whole numbers; null if it is no such list."""
    return F.from_json(c, "array<int>")


def field_time(record: Column, question: str) -> Column:
    """Range tag of a JSON record's question; a plain field stands in for the final one only where that key is absent, not where it is null."""
    keys = F.json_object_keys(record)

    def get(part):
        final_, plain = f"[Final]{question}{part}", f"{question}{part}"
        fields = F.from_json(record, "map<string,string>")
        return F.when(F.array_contains(keys, final_), F.element_at(fields, final_)).otherwise(F.element_at(fields, plain))

    return F.coalesce(range_tag(get("_start_sec"), get("_end_sec")), F.lit(""))


def consistency_score(c: Column) -> Column:
    hit = F.regexp_extract(c, r"(?i)Consistency\s*Score\s*[:：]?\s*\**\s*([01](?:\.\d+)?)", 1).try_cast("double")
    return F.when(hit.between(0.0, 1.0), hit)


def safe_stem(c: Column) -> Column:
    """A relative path as one name: folders joined by two underscores, the last suffix gone."""
    name = F.regexp_extract(c, r"([^/]*)\z", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")
    parent = F.regexp_replace(F.regexp_replace(c, r"/?[^/]*\z", ""), "/", "__")
    return F.concat(F.when(parent == "", F.lit(".")).otherwise(parent), F.lit("__"), stem)


def absolute_path(base: Column, path: Column) -> Column:
    joined = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), path))
    return F.regexp_replace(joined, r"/\./|/{2,}", "/")


def prompt_between(c: Column, loose: bool = True) -> Column:
    """The prompt between its markers, null if they are not there; the strict form wants a line end before the second."""
    pattern = (
        r"(?is)Textual prompt\s*:\s*(.*?)(?=\s*Assess whether the video is well-aligned)" if loose else r"(?s)Textual prompt:\s*(.*?)\nAssess whether"
    )
    return let(c, lambda t: F.when(t.rlike(pattern), strip(F.regexp_extract(t, pattern, 1))))


def video_candidates(video: Column, roots: list[str], here: str) -> Column:
    """Places where a relative video may be, each once, in order; an absolute one is the only place."""
    inner = F.regexp_replace(video, "^videos/+", "")
    places = []
    for root in roots:
        places.append(absolute_path(F.lit(root), video))
        if root.rstrip("/").rpartition("/")[2] == "videos":
            places.append(F.when(F.startswith(video, F.lit("videos/")), absolute_path(F.lit(root), inner)))
    places.append(absolute_path(F.lit(here), video))
    places.append(F.when(~F.startswith(video, F.lit("data/")), absolute_path(F.lit(f"{here}/data"), video)))
    found = F.array_distinct(F.filter(F.array(*places), lambda p: p.isNotNull()))
    return F.when(F.startswith(video, F.lit("/")), F.array(video)).otherwise(found)


def has_caption(c: Column) -> Column:
    at = F.locate("<think>", c)
    return (at > 0) & c.substr(at + 7, F.length(c)).rlike(r"(?i)^\s*Video Caption\s*:")


def clean_caption(c: Column) -> Column:
    """A caption without tags, speaker, label and quotes; null if nothing is left."""
    s = F.regexp_replace(strip(c), r"(?i)</?(?:think|answer)>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)^assistant\s*[:：]\s*", ""), r"(?i)^(video\s*)?caption\s*[:：]\s*", "")
    s = F.btrim(strip(squeeze(s)), F.lit(" \t\r\n\"'"))
    return F.when(s != "", s)


def insert_caption(c: Column, caption: Column, prefix: str = "Video Caption: ") -> Column:
    """A caption line at the head of the think block, in place of one that stands there."""
    at, line = F.locate("<think>", c), F.concat(F.lit(prefix), caption)
    rest = c.substr(at + 7, F.length(c))
    feed = F.regexp_extract(rest, r"^(\r?\n|)", 1)
    body = rest.substr(F.length(feed) + 1, F.length(c))
    captioned = body.rlike(r"(?i)^\s*Video Caption\s*:")
    tail = F.when(captioned, F.regexp_replace(body, r"^[^\n]*", "")).otherwise(F.concat(F.lit("\n"), body))
    bare = F.concat(F.lit("<think>\n"), line, F.lit("\n"), F.regexp_replace(c, r"(?U)^\s+", ""))
    return F.when(at > 0, F.concat(c.substr(F.lit(1), at + 6), feed, line, tail)).otherwise(bare)


def fix_subject_object(c: Column) -> Column:
    """A stray reason in the last answer moves to the alignment claim, and the answer is No."""
    soi = r"(?s)(Subject-Object Interaction:\s*)(.*?)(?=\n|</answer>)"
    claim = r"(?s)(\[Prompt Alignment\]:\s*)(.*?)(?=\s*\[.*?\]:|</think>)"
    value = F.replace(F.replace(strip(F.regexp_extract(c, soi, 2)), F.lit(".."), F.lit(".")), F.lit(". ."), F.lit("."))
    old = strip(F.regexp_extract(c, claim, 2))
    new = F.concat(old, F.when(F.endswith(old, F.lit(".")), F.lit(" ")).otherwise(F.lit(". ")), value)

    def once(text, pattern, put):
        hit = F.regexp_extract(text, pattern, 0)
        at = F.regexp_instr(text, F.lit(pattern))
        return F.when(at > 0, F.concat(text.substr(F.lit(1), at - 1), put, text.substr(at + F.length(hit), F.length(text)))).otherwise(text)

    moved = once(once(c, claim, F.concat(F.regexp_extract(c, claim, 1), new)), soi, F.lit("Subject-Object Interaction: No."))
    return F.when(~c.rlike(soi) | value.isin("Yes.", "No."), c).otherwise(moved)
