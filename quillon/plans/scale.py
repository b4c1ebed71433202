"""Queries of what works over groups of any size, on words and spans of the tables' own texts; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import arrays, scan, text
from quillon.operators import incremental, intervals, joins, records
from quillon.plans.queries import SPANS, SQL, _dialogue, query, rendered, table
from quillon.scratch import shared_path
from quillon.sources import records as files
from quillon.sources import media, variants
from quillon.streaming import retries, snapshots

_TEXTS = "t AS (SELECT conv_id, turn, CAST(len(text) AS BIGINT) AS n FROM conversations WHERE text IS NOT NULL)"


@query(f"""
WITH {_TEXTS}, tokens AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, k * 10 AS b, k * 10 + 10 AS e, k AS id FROM t, unnest(range(0, n // 10 + 1)) AS u(k)),
spans AS (SELECT conv_id, n // 4 AS b, n // 2 AS e FROM t UNION ALL SELECT conv_id, n - 5, n FROM t WHERE n % 3 = 0)
SELECT conv_id, turn, id, CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.conv_id = k.conv_id AND k.b < s.e AND k.e > s.b) THEN id ELSE -100 END AS label FROM tokens k""")
def token_rows_labelled(spark, sf_dir):
    """A token a row, under the spans of all turns of its conversation."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.length("text").cast("long").alias("n"))
    tokens = rows.select("conv_id", "turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 10).cast("long"))).alias("id"))
    tokens = tokens.select("conv_id", "turn", "id", (F.col("id") * 10).alias("begin"), (F.col("id") * 10 + 10).alias("end"))
    quarter = rows.select("conv_id", F.floor(F.col("n") / 4).alias("begin"), F.floor(F.col("n") / 2).alias("end"))
    spans = quarter.unionByName(rows.where("n % 3 = 0").select("conv_id", (F.col("n") - 5).alias("begin"), F.col("n").alias("end")))
    return intervals.label_rows(tokens, spans, ["conv_id"]).select("conv_id", "turn", "id", "label")


_SPAN = "SELECT user_id, event_id, event_type, event_id % 500 AS b, event_id % 500 + CASE WHEN event_id % 50 = 0 THEN 400 ELSE 1 + event_id % 7 END AS e FROM events"


@query(f"WITH s AS ({_SPAN}) SELECT l.event_id, r.event_id AS other FROM s l JOIN s r ON l.user_id = r.user_id AND l.b < r.e AND l.e > r.b WHERE l.event_type = 'view' AND r.event_type <> 'view'")
def overlapping_spans(spark, sf_dir):
    """Spans of a user's views and of the same user's other events, some of them long, where they overlap."""
    spans = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type", "event_id % 500 AS begin", "event_id % 500 + CASE WHEN event_id % 50 = 0 THEN 400 ELSE 1 + event_id % 7 END AS end")
    pairs = intervals.overlapping(spans.where("event_type = 'view'"), spans.where("event_type <> 'view'"), ["user_id"])
    return pairs.select("l.event_id", F.col("r.event_id").alias("other"))


_NOUNS = ("ball", "It", "falls", "violation", "Rest", "answer>Yes", "zebra")


@query(f"""
WITH s AS (SELECT event_id, {SPANS} AS t FROM events), w AS (SELECT *, unnest({list(_NOUNS)!r}) AS noun FROM s),
p AS (SELECT event_id, noun, strpos(t, noun) AS place, strpos(t, '</t>') + 4 AS after, regexp_extract_all(t, '<t>', 0) AS tags FROM w)
SELECT event_id, noun, CAST(place - 1 AS INTEGER) AS begin, CAST(place - 1 + length(noun) AS INTEGER) AS "end" FROM p WHERE place >= after""")
def mentions_of_a_dictionary(spark, sf_dir):
    """Nouns of one dictionary in all texts, where they first stand behind a time range."""
    found = scan.dictionary_mentions(rendered(spark, sf_dir, "events", "event_id", t=SPANS), "t", list(_NOUNS))
    return found.select("event_id", F.explode("mentions").alias("m")).select("event_id", "m.noun", "m.begin", "m.end")


@query("SELECT conv_id, turn, array_to_string(list_filter(range(0, len(text) - 1), lambda k: substr(text, CAST(k + 1 AS INTEGER), 2) = 'th'), ',') AS found FROM conversations WHERE text IS NOT NULL")
def token_pattern(spark, sf_dir):
    """A pattern of two ids in sequences of ids, those of a text's characters."""
    ids = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    found = scan.find_pattern_udf(ids(F.col("text")), ids(F.lit("th")))
    return rows.select("conv_id", "turn", F.array_join(found.cast("array<string>"), ",").alias("found"))


@query("SELECT conv_id, turn, CASE WHEN len(text) < 4 THEN text ELSE concat('<', substr(text, 2, 1), '|', substr(text, 4, len(text) - 4), '!>') END AS spliced FROM conversations WHERE text IS NOT NULL")
def spliced_replacements(spark, sf_dir):
    """First, third and last character replaced, given in no order."""
    n = F.length("text")
    edit = lambda b, e, t: F.struct(F.lit(b).alias("begin") if isinstance(b, int) else b.alias("begin"), F.lit(e).alias("end") if isinstance(e, int) else e.alias("end"), F.lit(t).alias("text"))
    edits = F.when(n >= 4, F.array(edit(2, 3, "|"), edit(n - 1, n, "!>"), edit(0, 1, "<"))).otherwise(F.array().cast("array<struct<begin:int,end:int,text:string>>"))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", text.apply_replacements(F.col("text"), edits).alias("spliced"))


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id")
def appended_records(spark, sf_dir):
    """Records of two runs behind one another at one place."""
    path, rows = shared_path(spark, "appended"), table(spark, sf_dir, "labels")
    files.append_records(rows.select("doc_id"), path)
    files.append_records(rows.where("toxic = 1").select("doc_id"), path)
    return files.read_jsonl(spark, path, "doc_id long").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _grids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_size % 3 + 1 AS INT) AS a", "CAST(p_size % 3 + 1 AS INT) AS t_", "CAST(p_size % 4 * 2 AS INT) AS h_")
    n = (F.col("t_") * (F.col("h_") / 2) * 2).cast("int")
    ids = F.concat(F.array_repeat(F.lit(1), F.col("a")), F.array_repeat(F.lit(10), n), F.array_repeat(F.lit(2), 2))
    return rows.select("p_partkey", ids.alias("ids"), F.when(n > 0, F.array(F.array(F.col("t_"), F.col("h_"), F.lit(4)))).otherwise(F.array().cast("array<array<int>>")).alias("grids"))


def _rope_sql(time: str, jump: str, whole: str) -> str:
    """Positions of a text, a video of t frames of h / 2 by 2 cells, and two ids; ``base`` where a frame's cells count from."""
    return f"""
WITH s AS (SELECT p_partkey, p_size % 3 + 1 AS a, p_size % 3 + 1 AS t, p_size % 4 AS r FROM part), b AS (SELECT *, t * r * 2 AS n FROM s),
x AS (SELECT *, list_transform(range(0, n), lambda k: {time}) AS bt, list_transform(range(0, n), lambda k: {jump} + k // 2 % greatest(r, 1)) AS bh, list_transform(range(0, n), lambda k: {jump} + k % 2) AS bw,
  CASE WHEN n = 0 THEN a ELSE a + {whole} END AS z FROM b)
SELECT p_partkey, {", ".join(f"array_to_string(list_concat(list_concat(range(0, a), b{c}), range(z, z + 2)), ',') AS {c}" for c in "thw")} FROM x"""


_FRAME = "k // greatest(r * 2, 1)"


def _rope(spark, sf_dir, **options):
    out = arrays.rope_ids(_grids(spark, sf_dir), "ids", "grids", 8, 9, 10, **options)
    return out.select("p_partkey", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in "thw"])


@query(_rope_sql(f"a + {_FRAME} * greatest(r, 2)", f"a + {_FRAME} * greatest(r, 2)", "t * greatest(r, 2)"))
def rope_ids_per_frame(spark, sf_dir):
    """Every frame is a grid of its own, with time 0."""
    return _rope(spark, sf_dir, per_frame=True)


@query(_rope_sql(f"a + CAST(floor({_FRAME} * 2.5) AS BIGINT)", "a", "greatest(CAST(floor((t - 1) * 2.5) AS BIGINT), r - 1, 1) + 1"))
def rope_ids_by_seconds(spark, sf_dir):
    """Time counts two and a half positions a frame."""
    return _rope(spark, sf_dir, time_scale=2.5)


# -- records of mixed shape, statistics of the same pass, output rewritten, aggregates kept ---------------


_MIXED = (
    "concat('{\"id\": ', CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR(20)) WHEN 1 THEN concat('\"d', CAST(doc_id AS VARCHAR(20)), '\"') WHEN 2 THEN concat('[', CAST(doc_id AS VARCHAR(20)), ',\"x\"]') ELSE concat('{\"k\":', CAST(doc_id AS VARCHAR(20)), '}') END, "
    "', \"video\": ', CASE WHEN doc_id % 3 = 0 THEN '[\"a\",\"b\"]' WHEN doc_id % 3 = 1 THEN '\"a\"' ELSE 'null' END, ', \"image\": \"i\"}')"
)


@query(
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'array' ELSE 'object' END AS kind, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN concat('d', doc_id) WHEN 2 THEN concat('[', doc_id, ',\"x\"]') ELSE concat('{\"k\":', doc_id, '}') END AS id, "
    "CASE doc_id % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'a' ELSE 'i' END AS media FROM labels"
)
def variant_round_trip(spark, sf_dir):
    """Ids of four kinds and media in three shapes, read, written, and read again."""
    path = shared_path(spark, "variants")
    rows = rendered(spark, sf_dir, "labels", "doc_id", value=_MIXED).withColumn("record", F.parse_json("value"))
    both = rows.select(variants.with_part(F.col("record"), {"doc_id": F.col("doc_id"), "r": F.col("record")}).alias("record"))
    variants.write_variants(both, path)
    back = variants.read_variants(spark, path)
    ident = variants.part(F.col("record"), "$.r.id")
    return back.select(F.variant_get("record", "$.doc_id", "long").alias("doc_id"), variants.kind(ident).alias("kind"), variants.as_text(ident).alias("id"), F.array_join(variants.media(F.col("record"), "$.r.video", "$.r.image"), ",").alias("media"))


@query(SQL["validator_stats"])
def observed_stats(spark, sf_dir):
    """The validator's totals, told by the job that writes sound records and those with problems."""
    path = shared_path(spark, "split")
    rows = _dialogue(spark, sf_dir).withColumn("problems", records.problems(F.col("conversations"), F.col("images"), F.col("videos")))
    found = files.write_split(rows, f"{path}/sound", f"{path}/problem", stats=records.validation_counts())
    written = {p: spark.read.text(f"{path}/{p}").count() for p in ("sound", "problem")}
    assert written == {"sound": found["valid_entries"], "problem": found["total_entries"] - found["valid_entries"]}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


@query("SELECT conv_id, turn, text IS NULL AS bad FROM conversations")
def quarantined_lines(spark, sf_dir):
    """Lines that are no JSON are set aside whole; both kinds are there, and are counted as they pass."""
    path = shared_path(spark, "sift")
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.when(F.col("text").isNull(), "{broken ").otherwise(""), F.to_json(F.struct("conv_id", "turn"))).alias("value"))
    rows.write.text(f"{path}/in")
    found = files.sift(spark, f"{path}/in", "conv_id long, turn long", f"{path}/good", f"{path}/bad")
    back = lambda p: spark.read.schema("source_file string, line int, value string").json(f"{path}/{p}")
    good, bad = back("good"), back("bad").where("line > 0 and source_file is not null")
    assert found["lines"] == found["good"] + found["bad"]
    parsed = good.select(F.from_json("value", "conv_id long, turn long").alias("r"), F.lit(False).alias("bad"))
    parsed = parsed.unionByName(bad.select(F.from_json(F.substring("value", 9, 1 << 20), "conv_id long, turn long").alias("r"), F.lit(True).alias("bad")))
    return parsed.select("r.conv_id", F.col("r.turn").cast("int").alias("turn"), "bad")


@query("SELECT doc_id, concat('done ', doc_id) AS out FROM (SELECT DISTINCT doc_id FROM labels)")
def rewritten_output(spark, sf_dir):
    """An output rewritten every so many items, by a run that breaks off and one that goes on behind it."""
    path, rows = shared_path(spark, "rewritten"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    every = -(-rows.count() // 3)
    calls = []

    def step(df):
        calls.append(df)
        if len(calls) == 2:
            raise RuntimeError("broken off")
        return df.select("doc_id", F.concat(F.lit("done "), F.col("doc_id").cast("string")).alias("out"))

    try:
        snapshots.rewrite_every(spark, rows, step, path, "doc_id", every)
    except RuntimeError:
        pass
    return snapshots.rewrite_every(spark, rows, step, path, "doc_id", every)


@query(
    "SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS views, round(sum(value), 4) AS total, arg_max(event_id, value * 1000000 - event_id * 1e-9) AS top, "
    "(SELECT string_agg(event_type, ',' ORDER BY first) FROM (SELECT event_type, min(event_id) AS first FROM events o WHERE o.user_id = e.user_id GROUP BY event_type)) AS kinds FROM events e GROUP BY user_id".replace("arg_max(event_id, value * 1000000 - event_id * 1e-9)", "CAST(max_by(event_id, struct_pack(s := CAST(floor(value * 1000) AS BIGINT), t := -event_id)) AS BIGINT)")
)
def incremental_aggregates(spark, sf_dir):
    """Three batches, one of them wrong at first and replaced; the states combined are the whole's."""
    path, events = shared_path(spark, "states"), table(spark, sf_dir, "events")
    score = F.floor(F.col("value") * 1000).cast("long")
    kept = incremental.Aggregates(path, ["user_id"], {
        "views": incremental.count_if(F.col("event_type") == "view"), "total": incremental.total(F.col("value")),
        "top": incremental.best(F.col("event_id"), score, F.col("event_id")),
    }, {"kinds": (F.col("event_type"), F.col("event_id"))})
    for batch in range(3):
        kept.put(events.where(F.col("event_id") % 3 == batch).withColumn("value", F.col("value") + int(batch == 1)), batch)
    kept.put(events.where("event_id % 3 = 1"), 1)
    return kept.result(spark).select("user_id", F.col("views").cast("long").alias("views"), F.round("total", 4).alias("total"), "top", F.array_join("kinds", ",").alias("kinds"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'dead' ELSE 'done' END AS state, CASE WHEN doc_id % 3 = 0 THEN 'ValueError: no answer' END AS error FROM (SELECT DISTINCT doc_id FROM labels)")
def retried_requests(spark, sf_dir):
    """A stream whose keys carry their tries, in two runs over the same requests: each key is answered or given up once."""
    path = shared_path(spark, "retries")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("q"))

    def ask():
        def answer(q):
            if int(q) % 3 == 0:
                raise ValueError("no answer")
            return f"re {q}"

        return answer

    for run in range(2):
        rows.write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema("doc_id long, q string").parquet(f"{path}/in")
        retries.answer_stream(source, "doc_id", "q", ask, f"{path}/out", f"{path}/checkpoint", attempts=1).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", "state", "error")


# -- principal components in two scopes; sequences made of the texts' own characters -----------------------

_SPREAD = "WITH x AS (SELECT {g} AS g, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings), d AS (SELECT g, vec_id, generate_subscripts(e, 1) AS k, unnest(e) AS v FROM x), c AS (SELECT vec_id, v - avg(v) OVER (PARTITION BY g, k) AS v FROM d) SELECT vec_id, round(sum(v * v), 3) AS spread, true AS falling FROM c GROUP BY vec_id"


def _spreads(spark, sf_dir, group):
    """All components of every vector: their squares add up to its distance from the mean, and their spreads fall."""
    rows = table(spark, sf_dir, "embeddings").select(group.alias("g"), "vec_id", "embedding")
    d = rows.select(F.size("embedding").alias("d")).agg(F.max("d")).first()[0]
    found = arrays.principal_maps(rows, ["g"], "embedding", "vec_id", components=d, kept=d)
    square = lambda c: c * c
    by_place = found.select("g", F.posexplode("pca").alias("k", "v")).groupBy("g", "k").agg(F.sum(square(F.col("v"))).alias("s"))
    listed = by_place.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("l"))  # as many as dimensions
    falls = listed.select("g", F.forall(F.sequence(F.lit(1), F.size("l") - 1), lambda k: F.get("l", k)["s"] <= F.get("l", k - 1)["s"] * (1 + 1e-9) + 1e-9).alias("falling"))
    total = F.aggregate("pca", F.lit(0.0), lambda a, v: a + v * v)
    return found.select("g", "vec_id", F.round(total, 3).alias("spread")).join(falls, "g").select("vec_id", "spread", "falling")


@query(_SPREAD.format(g="label"))
def components_of_clips(spark, sf_dir):
    return _spreads(spark, sf_dir, F.col("label"))


@query(_SPREAD.format(g="label * 1000 + vec_id % 7"))
def components_of_frames(spark, sf_dir):
    """The same within each frame of a clip."""
    return _spreads(spark, sf_dir, F.col("label") * 1000 + F.col("vec_id") % 7)


def _codes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    ids = F.transform(F.filter(F.split("t", ""), lambda c: c != ""), lambda c: F.ascii(c))
    return rows.select("conv_id", "turn", ids.alias("ids")).withColumns({"labels": F.col("ids"), "positions": F.transform("ids", lambda _, k: k)})


_CODES = "s AS (SELECT conv_id, turn, list_transform(list_filter(string_split(COALESCE(text, ''), ''), lambda c: c <> ''), lambda c: unicode(c)) AS ids FROM conversations)"


@query(
    f"WITH {_CODES}, w AS (SELECT *, least(len(ids), 64) AS n, max(least(len(ids), 64)) OVER (PARTITION BY conv_id) AS w FROM s) SELECT conv_id, turn, array_to_string(list_transform(range(1, w + 1), lambda k: CASE WHEN k <= n THEN ids[k] ELSE 0 END), ',') AS ids, "
    "array_to_string(list_transform(range(1, w + 1), lambda k: CASE WHEN k <= n THEN ids[k] ELSE -100 END), ',') AS labels, array_to_string(list_transform(range(1, w + 1), lambda k: CASE WHEN k <= n THEN k - 1 ELSE 1 END), ',') AS positions, array_to_string(list_transform(range(1, w + 1), lambda k: CASE WHEN k <= n THEN 1 ELSE 0 END), ',') AS mask FROM w"
)
def pad_collate_texts(spark, sf_dir):
    out = arrays.collate(_codes(spark, sf_dir), "conv_id", 64)
    return out.select("conv_id", "turn", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ids", "labels", "positions", "mask")])


@query(
    f"WITH {_CODES}, c AS (SELECT *, sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn, ids ROWS UNBOUNDED PRECEDING) AS cu FROM s) SELECT conv_id, '0,' || string_agg(CAST(CAST(cu AS BIGINT) AS VARCHAR), ',' ORDER BY turn, ids) AS cu_seqlens, md5(string_agg(array_to_string(ids, ','), ',' ORDER BY turn, ids) FILTER (WHERE len(ids) > 0)) AS ids FROM c GROUP BY conv_id"
)
def cu_seqlens_texts(spark, sf_dir):
    out = arrays.flatten_batch(_codes(spark, sf_dir), "conv_id", "turn")
    whole = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("conv_id", F.array_join(F.col("cu_seqlens").cast("array<string>"), ",").alias("cu_seqlens"), F.when(F.size("ids") > 0, F.md5(whole.cast("binary"))).alias("ids"))


@query(
    f"WITH {_CODES}, m AS (SELECT conv_id, turn, ids, list_transform(ids, lambda c: CAST(c % 3 > 0 AS INTEGER)) AS m FROM s) SELECT conv_id, turn, array_to_string(list_transform(range(1, len(m) + 1), lambda k: CASE WHEN m[k] = 1 THEN CAST(list_sum(m[1:k]) AS BIGINT) - 1 ELSE 0 END), ',') AS hidden, "
    "CASE WHEN len(ids) > 0 AND ids[len(ids)] = 46 THEN array_to_string(ids, ',') ELSE array_to_string(list_append(ids, 46), ',') END AS eos FROM m"
)
def masked_positions_of_texts(spark, sf_dir):
    """Positions under masks of the texts themselves, and texts that end with a full stop or get one."""
    rows = _codes(spark, sf_dir)
    line = lambda c: F.array_join(c.cast("array<string>"), ",")
    mask = F.transform("ids", lambda c: (c % 3 > 0).cast("int"))
    return rows.select("conv_id", "turn", line(arrays.masked_positions(mask)).alias("hidden"), line(arrays.with_eos(F.col("ids"), 46)).alias("eos"))


# -- media that are there ---------------------------------------------------------------------------------


def _media(spark, sf_dir, roots):
    """Folders of files, named by numbers below 50, at each root those for which a test of the number holds; returns their common path."""
    path = shared_path(spark, "media")
    names = table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("k")).distinct()
    for root, test in roots.items():
        names.where(test).select(F.col("k").cast("string").alias("value"), F.col("k").alias("name")).write.partitionBy("name").text(f"{path}/{root}")
    return path


@query(
    "SELECT count(*) AS total_entries, count(*) FILTER (WHERE doc_id % 9 <> 0 AND doc_id % 10 <> 0 AND NOT gone) AS valid_entries, count(*) FILTER (WHERE gone) AS missing_media, count(*) FILTER (WHERE doc_id % 9 = 0) AS token_mismatches, "
    "count(*) FILTER (WHERE doc_id % 10 = 0) AS gpt_media_tokens, count(*) FILTER (WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0) AS image_only, count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0) AS video_only, count(*) FILTER (WHERE doc_id % 12 = 0) AS mixed "
    "FROM (SELECT doc_id, doc_id % 50 % 6 = 0 AND (doc_id % 4 = 0 OR doc_id % 3 = 0) AS gone FROM (SELECT DISTINCT doc_id FROM labels))"
)
def validator_stats_of_files(spark, sf_dir):
    """The validator's totals where some of the media that records name aren't there."""
    path = _media(spark, sf_dir, {"m": "k % 6 <> 0"})
    rows = _dialogue(spark, sf_dir).dropDuplicates(["doc_id"])
    there = media.media_folders(media.media_files(spark, f"{path}/m"))
    wanted = F.when(F.size("images") + F.size("videos") > 0, F.array(media.bare(F.concat(F.lit(f"{path}/m/name="), (F.col("doc_id") % 50).cast("string"))))).otherwise(F.array().cast("array<string>"))
    rows = media.with_missing(rows, "doc_id", wanted, there)
    return records.validation_stats(rows.withColumn("problems", records.problems(F.col("conversations"), F.col("images"), F.col("videos"), F.col("missing"))))


@query("SELECT doc_id, CASE WHEN doc_id % 50 % 3 = 0 THEN 'a' ELSE 'b' END AS root FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id % 50 % 3 = 0 OR doc_id % 50 % 2 = 0")
def first_existing_file(spark, sf_dir):
    """Of two places the first where the file is."""
    path = _media(spark, sf_dir, {"a": "k % 3 = 0", "b": "k % 2 = 0"})
    there = media.media_folders(media.media_files(spark, [f"{path}/a", f"{path}/b"]))
    place = lambda root: media.bare(F.concat(F.lit(f"{path}/{root}/name="), (F.col("doc_id") % 50).cast("string")))
    tries = table(spark, sf_dir, "labels").select("doc_id").distinct().select("doc_id", F.posexplode(F.array(place("a"), place("b"))).alias("rank", "path"))
    found = joins.first_existing(tries, there, ["doc_id"], "rank", "path")
    return found.select("doc_id", F.element_at(F.split("path", "/"), -2).alias("root"))
