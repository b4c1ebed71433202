"""The ``opN_*`` queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import importance, langid, maxscore, mixing, mixlm, packing, pieces, quality, ranking, sharding, simhash, spans, suffixes
from quillon.llm.common import crc32_of_id, materialize, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


@query
def op4_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read_table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op6_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, bits=64, radius=2)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op2_isolation_forest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = materialize(quality.rule_statistics(docs), "quality-statistics")
    judged = quality.judge(stats, read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "anomaly")


@query
def op5_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc32_of_id(F.col("doc_id")) % 4 == 2
    found = langid.identify(docs, train=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return maxscore.search(vectors, "id % 50 = 0", k=5)


SQL["op7_maxscore_top_k"] = """
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.row_id, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.row_id <> c.row_id
  WHERE q.vec_id % 50 = 0
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def mixture():
    """Domain and weights of the tests and the pipeline: parts of a thousand, sources alike."""
    digit = F.conv(F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int")
    return F.concat(F.lit("d"), (digit % 4).cast("string")), {
        "domain": F.expr("CASE domain WHEN 'd0' THEN 400 WHEN 'd1' THEN 300 WHEN 'd2' THEN 200 ELSE 100 END"),
        "lang": F.expr("CASE lang WHEN 'en' THEN 500 WHEN 'fr' THEN 200 WHEN 'de' THEN 200 WHEN 'es' THEN 100 ELSE 50 END"),
        "source": F.lit(1),
    }


@query
def op1_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read_table(spark, sf_dir, "documents"), *mixture())
    return found.select(F.col("doc.doc_id").alias("doc_id"), *mixing.LEVELS, "n_tokens", "copies")


def _level(name: str, parents: str, weight: str, given: str) -> str:
    names = f"{parents}, {name}" if parents else name
    part = f"PARTITION BY {parents}" if parents else ""
    return f"""
{name}_nodes AS (
  SELECT n.*, {given} AS given FROM (
    SELECT {names}, CAST(SUM(tokens) AS BIGINT) * 2 AS capacity, {weight} AS weight FROM leaves GROUP BY {names}
  ) n {f"JOIN {parents.split(', ')[-1]}_filled p USING ({parents})" if parents else ""}
),
{name}_ranked AS (
  SELECT *, COALESCE(SUM(capacity) OVER w, 0) AS spent,
         SUM(weight) OVER ({part}) - COALESCE(SUM(weight) OVER w, 0) AS weights
  FROM {name}_nodes
  WINDOW w AS ({part} ORDER BY capacity / CAST(weight AS DOUBLE), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
{name}_levels AS (
  SELECT *, MAX(CAST(given - spent AS DOUBLE) / CAST(weights AS DOUBLE)) OVER ({part}) AS level FROM {name}_ranked
),
{name}_filled AS (
  SELECT {names}, GREATEST(0, LEAST(capacity, CAST(floor(level * weight + 1e-6) AS BIGINT))) AS budget FROM {name}_levels
),"""


SQL["op1_hierarchical_mixing"] = (
    """
WITH rows_ AS (
  SELECT doc_id, 'd' || CAST(CAST('0x' || substr(md5(COALESCE(source, '')), 1, 1) AS INTEGER) % 4 AS VARCHAR) AS domain,
         COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents
),
leaves AS (SELECT domain, lang, source, CAST(SUM(n_tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY ALL),"""
    + _level("domain", "", "CASE domain WHEN 'd0' THEN 400 WHEN 'd1' THEN 300 WHEN 'd2' THEN 200 ELSE 100 END", "(SELECT SUM(tokens) FROM leaves)")
    + _level("lang", "domain", "CASE lang WHEN 'en' THEN 500 WHEN 'fr' THEN 200 WHEN 'de' THEN 200 WHEN 'es' THEN 100 ELSE 50 END", "p.budget")
    + _level("source", "domain, lang", "1", "p.budget")
    + """
plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
         budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest
  FROM source_filled JOIN leaves USING (domain, lang, source)
),
placed AS (
  SELECT rows_.*, epochs, rest, md5('17:' || CAST(epochs AS VARCHAR) || ':' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS key
  FROM rows_ JOIN plan USING (domain, lang, source)
),
summed AS (
  SELECT *, SUM(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens RANGE UNBOUNDED PRECEDING) AS after,
         SUM(n_tokens) OVER (PARTITION BY domain, lang, source, key, n_tokens) AS own
  FROM placed
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN 2 * after - own <= 2 * rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM summed
"""
)


@query
def op9_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.dedup_spans(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "text", "n_parts", "n_removed")


@query
def op10_sparse_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_passages(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"))


SQL["op10_sparse_suffix_passages"] = """
WITH docs AS (
  SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
),
windows AS (
  SELECT doc_id, md5(text) AS key, k, md5(array_to_string(w[k + 1 : k + 50], ' ')) AS h FROM docs, unnest(range(0, greatest(len(w) - 49, 0))) AS t(k)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS FIRST, key, k) AS nth FROM windows
),
repeated AS (
  SELECT doc_id, key, k, lag(k) OVER (PARTITION BY doc_id, key ORDER BY k) AS before FROM placed WHERE nth > 1
),
passages AS (
  SELECT *, sum(CASE WHEN before IS NULL OR k > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, key ORDER BY k) AS passage FROM repeated
)
SELECT doc_id, CAST(min(k) AS INTEGER) AS begin, CAST(max(k) + 50 AS INTEGER) AS "end", CAST(max(k) + 50 - min(k) AS INTEGER) AS n_words
FROM passages GROUP BY doc_id, key, passage
"""


@query
def op8_context_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc32_of_id(F.col("doc_id")) % 7 == 2
    found = mixlm.score(docs, train=~held_out, label="lang")
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


SQL["op11_importance_resampling"] = r"""
WITH words AS (
  SELECT 'raw' AS side, doc_id, text IS NULL AS none, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'target', NULL, false, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
),
crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(1, 9)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) AS r(b)
  )
),
buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(hex(word)) + 1, 2), lambda i: CAST('0x' || substr(hex(word), CAST(i AS INTEGER), 2) AS BIGINT))),
                    lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), crc
),
counts AS (
  SELECT bucket, count(*) FILTER (side = 'raw') AS s, count(*) FILTER (side = 'target') AS t FROM words JOIN buckets USING (word) GROUP BY bucket
),
sums AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM counts, sums
),
weights AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS w FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'raw' GROUP BY doc_id
),
scored AS (
  SELECT d.doc_id, COALESCE(n, 0) AS n_features, COALESCE(w, 0) AS weight,
         COALESCE(w, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN drawn USING (doc_id)
"""


@query
def op12_block_max_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = ranking.index(read_table(spark, sf_dir, "documents"))
    return ranking.search(built, read_table(spark, sf_dir, "benchmark"), k=50)


SQL["op12_block_max_ranking"] = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
sizes AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * CAST(any_value(n_docs) AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term
),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query
def op13_distinct_chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.decode(pieces.encode(read_table(spark, sf_dir, "documents"), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
