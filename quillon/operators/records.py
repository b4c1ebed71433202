"""Annotation records: turns, media, messages, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.geometry import temporal_groups
from quillon.functions.text import absolute_path, strip, strip_think, word_count

TURN = "array<struct<from:string,value:string>>"
PART = "type:string,text:string,image:string,video:string"
#: Splits around media tokens, keeping them.
MEDIA = r"(?=<image>|<video>)|(?<=<image>)|(?<=<video>)"


def nest(turns: DataFrame, by: str, order: str, role: str, text: str) -> DataFrame:
    """Turn rows to one record per conversation, its turns in order. A conversation is bounded by its turns."""
    speaker = F.when(F.col(role) == "user", "human").when(F.col(role) == "assistant", "gpt").otherwise(F.col(role))
    turn = F.struct(F.col(order).alias("o"), speaker.alias("from"), F.col(text).alias("value"))
    packed = turns.groupBy(by).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return packed.select(by, F.transform("t", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))


def unnest(records: DataFrame, by: str) -> DataFrame:
    exploded = records.select(by, F.posexplode("conversations").alias("turn", "t"))
    return exploded.select(by, "turn", role_of(F.col("t.from")).alias("role"), F.col("t.value").alias("text"))


def role_of(speaker: Column) -> Column:
    return F.when(speaker == "human", "user").otherwise("assistant")


def first_value(conversations: Column, speaker: str) -> Column:
    """Value of the first turn of a speaker; null for a human, '' for the model, where there is none."""
    said = F.filter(conversations, lambda t: t["from"] == speaker)
    return F.coalesce(F.try_element_at(said, F.lit(1))["value"], F.lit(None if speaker == "human" else ""))


def required_value(conversations: Column, speaker: str = "human") -> Column:
    """Value of the first turn of a speaker; a record without one raises."""
    found = first_value(conversations, speaker)
    has = F.exists(conversations, lambda t: t["from"] == speaker)
    return F.when(F.coalesce(has, F.lit(False)), found).otherwise(F.raise_error(F.lit(f"no turn of {speaker}")).cast("string"))


def last_value(conversations: Column) -> Column:
    return F.try_element_at(conversations, F.lit(-1))["value"]


def response(conversations: Column, which: str) -> Column:
    """The assistant's turn by one of three rules: 'first' of the model, 'last' turn, or the 'second' turn."""
    second = F.try_element_at(conversations, F.lit(2))["value"]
    return {"first": first_value(conversations, "gpt"), "last": last_value(conversations), "second": second}[which]


def drop_nullish(records: DataFrame) -> DataFrame:
    """Records whose last turn holds 'null' in any case are left out; a null value holds nothing."""
    return records.where(~F.coalesce(F.contains(F.lower(last_value(F.col("conversations"))), F.lit("null")), F.lit(False)))


def media_list(*fields: Column) -> Column:
    """The first field that is there, text or JSON list of texts, as an array."""
    c = F.coalesce(*[f.cast("string") for f in fields])
    listed = F.from_json(c, "array<string>")
    return F.when(c.isNull(), F.array().cast("array<string>")).when(F.startswith(F.trim(c), F.lit("[")), listed).otherwise(F.array(c))


def token_count(conversations: Column, token: str, speaker: str) -> Column:
    each = lambda t: F.when(t["from"] == speaker, F.size(F.split(F.coalesce(t["value"], F.lit("")), token)) - 1).otherwise(0)
    return F.aggregate(F.transform(conversations, each), F.lit(0), lambda a, n: a + n)


def problems(conversations: Column, images: Column, videos: Column, missing: Column | None = None) -> Column:
    """Array of (type, media_type, expected, actual): missing files, one token mismatch at most, media tokens in responses."""
    kind = "struct<type:string,media_type:string,expected:int,actual:int>"
    row = lambda t, m=None, e=None, a=None: F.struct(F.lit(t).alias("type"), (F.lit(m) if m is None or isinstance(m, str) else m).cast("string").alias("media_type"), (F.lit(None) if e is None else e).cast("int").alias("expected"), (F.lit(None) if a is None else a).cast("int").alias("actual")).cast(kind)
    counts = {m: (F.size(pool), token_count(conversations, f"<{m}>", "human")) for m, pool in (("image", images), ("video", videos))}
    off = {m: e != a for m, (e, a) in counts.items()}
    mismatch = F.when(off["image"], row("token_mismatch", "image", *counts["image"])).when(off["video"], row("token_mismatch", "video", *counts["video"]))
    told = token_count(conversations, "<image>", "gpt") + token_count(conversations, "<video>", "gpt") > 0
    gone = F.when(F.size(missing) > 0, row("missing_files")) if missing is not None else F.lit(None).cast(kind)
    return F.filter(F.array(gone, mismatch, F.when(told, row("gpt_media_token"))), lambda p: p.isNotNull())


def validation_counts() -> dict[str, Column]:
    """Aggregates over records with images, videos and problems, for a table or for rows as they pass."""
    has = lambda kind: F.exists("problems", lambda p: p["type"] == kind)
    images, videos = F.size("images") > 0, F.size("videos") > 0
    return {
        "total_entries": F.count(F.lit(1)), "valid_entries": F.count_if(F.size("problems") == 0), "missing_media": F.count_if(has("missing_files")),
        "token_mismatches": F.count_if(has("token_mismatch")), "gpt_media_tokens": F.count_if(has("gpt_media_token")),
        "image_only": F.count_if(images & ~videos), "video_only": F.count_if(videos & ~images), "mixed": F.count_if(images & videos),
    }


def validation_stats(checked: DataFrame) -> DataFrame:
    """Totals over records with images, videos and problems."""
    return checked.agg(*[c.alias(k) for k, c in validation_counts().items()])


def word_lengths(conversations: Column, image: Column, video: Column):
    """(words plus 128 for an image, words or their negative without media)."""
    n = F.aggregate(F.transform(conversations, lambda t: word_count(F.coalesce(t["value"], F.lit("")))), F.lit(0), lambda a, x: a + x)
    return n + F.when(image.isNotNull(), 128).otherwise(0), F.when(image.isNotNull() | video.isNotNull(), n).otherwise(-n)


def messages(conversations: Column, images: Column, videos: Column, base: Column, cot: bool = True, time_instruction: Column | None = None):
    """Chat messages and an error: user text cut at media tokens, which take the next file; a time instruction leads the first text.

    The error, null if sound, says which placeholders and files don't match.
    """
    hint = F.coalesce(time_instruction, F.lit("")) if time_instruction is not None else F.lit("")
    blank = F.lit(None).cast("string")

    def part(kind, text=blank, image=blank, video=blank):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), image.alias("image"), video.alias("video"))

    def add(acc, seg):
        text = strip(seg)
        put = lambda p, i, v, told: F.struct(F.array_append(acc["out"], p).alias("out"), (acc["i"] + i).alias("i"), (acc["v"] + v).alias("v"), told.alias("told"))
        at = lambda pool, k: absolute_path(base, F.try_element_at(pool, k + 1))
        led = F.when(acc["told"] | (hint == ""), text).otherwise(F.concat(hint, F.lit("\n"), text))
        return (
            F.when(seg == "<image>", put(part("image", image=at(images, acc["i"])), 1, 0, acc["told"]))
            .when(seg == "<video>", put(part("video", video=at(videos, acc["v"])), 0, 1, acc["told"]))
            .when(text != "", put(part("text", led), 0, 0, F.lit(True)))
            .otherwise(acc)
        )

    def turn(acc, t):
        start = F.struct(F.array().cast(f"array<struct<{PART}>>").alias("out"), acc["i"].alias("i"), acc["v"].alias("v"), acc["told"].alias("told"))
        user = F.aggregate(F.split(t["value"], MEDIA), start, add)
        said = F.array(part("text", t["value"] if cot else strip_think(t["value"])))
        mine = t["from"] == "human"
        message = F.struct(role_of(t["from"]).alias("role"), F.when(mine, user["out"]).otherwise(said).alias("content"))
        keep = lambda k: F.when(mine, user[k]).otherwise(acc[k]).alias(k)
        return F.struct(F.array_append(acc["m"], message).alias("m"), keep("i"), keep("v"), keep("told"))

    start = F.struct(F.array().cast(f"array<struct<role:string,content:array<struct<{PART}>>>>").alias("m"), F.lit(0).alias("i"), F.lit(0).alias("v"), F.lit(False).alias("told"))
    done = F.aggregate(conversations, start, turn)
    error = F.lit(None).cast("string")
    for name, pool, k in (("video", videos, "v"), ("image", images, "i")):
        error = F.when(done[k] > F.size(pool), f"more <{name}> placeholders than files").when(done[k] < F.size(pool), f"unused {name} files").otherwise(error)
    return done["m"], error


def frame_lines(n_frames: Column) -> Column:
    """The placeholder of each frame of a video, one a line."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n_frames), lambda k: F.concat(F.lit("Frame"), k.cast("string"), F.lit(": <image>./</image>"))), "\n")


def frame_messages(conversations: Column, frames: Column, group: int, cot: bool = True, time_instruction: Column | None = None):
    """Messages with images and videos written out as frame placeholders, and the temporal groups.

    ``frames``: the number of frames of each video in order. A group is a run of frame numbers; an image is [-1].
    """
    hint = F.coalesce(time_instruction, F.lit("")) if time_instruction is not None else F.lit("")

    def add(acc, seg):
        text = strip(seg)
        n = F.coalesce(F.try_element_at(frames, acc["v"] + 1), F.lit(0))
        put = lambda line, v, used, more, told: F.struct(F.array_append(acc["out"], line).alias("out"), (acc["v"] + v).alias("v"), (acc["k"] + used).alias("k"), F.concat(acc["g"], more).alias("g"), told.alias("told"))
        none = F.array().cast("array<array<int>>")
        moved = F.transform(temporal_groups(n, group), lambda g: F.transform(g, lambda x: x + acc["k"]))
        led = F.when(acc["told"] | (hint == ""), text).otherwise(F.concat(hint, F.lit("\n"), text))
        return (
            F.when(seg == "<image>", put(F.lit("<image>./</image>"), 0, 1, F.array(F.array(F.lit(-1))), acc["told"]))
            .when(seg == "<video>", put(frame_lines(n), 1, n, moved, acc["told"]))
            .when(text != "", put(led, 0, 0, none, F.lit(True)))
            .otherwise(acc)
        )

    def turn(acc, t):
        start = F.struct(F.array().cast("array<string>").alias("out"), *[acc[k].alias(k) for k in ("v", "k", "g", "told")])
        user, mine = F.aggregate(F.split(t["value"], MEDIA), start, add), t["from"] == "human"
        text = F.when(mine, F.array_join(user["out"], "\n")).otherwise(t["value"] if cot else strip_think(t["value"]))
        message = F.struct(role_of(t["from"]).alias("role"), text.alias("content"))
        return F.struct(F.array_append(acc["m"], message).alias("m"), *[F.when(mine, user[k]).otherwise(acc[k]).alias(k) for k in ("v", "k", "g", "told")])

    start = F.struct(
        F.array().cast("array<struct<role:string,content:string>>").alias("m"), F.lit(0).alias("v"), F.lit(0).alias("k"),
        F.array().cast("array<array<int>>").alias("g"), F.lit(False).alias("told"),
    )
    done = F.aggregate(conversations, start, turn)
    return done["m"], done["g"]


def text_first(content: Column, role: Column) -> Column:
    """User parts with text before media."""
    return F.when(role == "user", F.concat(F.filter(content, lambda p: p["type"] == "text"), F.filter(content, lambda p: p["type"] != "text"))).otherwise(content)


def first_video(messages_: Column) -> Column:
    parts = F.flatten(F.transform(messages_, lambda m: m["content"]))
    return F.try_element_at(F.filter(parts, lambda p: p["type"] == "video"), F.lit(1))["video"]


def all_text(messages_: Column) -> Column:
    parts = F.flatten(F.transform(messages_, lambda m: m["content"]))
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")


def request(messages_: Column) -> Column:
    """(prompt, video) of the first message: its texts, and the last of its videos; null without one."""
    content = F.try_element_at(messages_, F.lit(1))["content"]
    videos = F.filter(content, lambda p: p["type"] == "video")
    text = F.array_join(F.transform(F.filter(content, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    return F.when(F.size(videos) > 0, F.struct(text.alias("prompt"), F.element_at(videos, -1)["video"].alias("video")))


def time_instruction(fps: Column, frames: Column, duration: Column) -> Column:
    """How a video was sampled; '' if any of it is unknown."""
    two = lambda x, n: F.replace(F.format_number(x, n), F.lit(","), F.lit(""))
    said = F.concat(F.lit("This video is uniformly sampled at "), two(fps, 2), F.lit(" fps, contains "), frames.cast("string"), F.lit(" frames from 0 seconds to "), two(duration, 1), F.lit(" seconds."))
    return F.coalesce(said, F.lit(""))


def pack_concat(members: DataFrame, by: str, order: str) -> DataFrame:
    """Members of a pack end to end: ids, labels, and positions that start anew with each."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "ids", "labels")))
    packed = members.groupBy(by).agg(rows.alias("m"))
    starts = F.transform("m", lambda m: F.transform(m["ids"], lambda x, i: i))
    return packed.select(by, F.flatten(F.transform("m", lambda m: m["ids"])).alias("ids"), F.flatten(F.transform("m", lambda m: m["labels"])).alias("labels"), F.flatten(starts).alias("positions"))
