"""Resampling, ranked search and SentencePiece ids against brute force and the library itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import importance, pieces, ranking

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "The of and Cat dog runs Éclair über 中文 x9 42 tree_house water, stone's light over".split()


def say(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, ties, nulls in every column, empty and very long texts, repeated rows, blanks at every place."""
    rng = random.Random(3)
    base = [say(rng, rng.randint(1, 90)) for _ in range(80)]
    rows = [(k, t, rng.choice(["en", None]), "src0", len(t)) for k, t in enumerate(base)]
    rows += [(100 + k, base[k % 5], "en", "src0", None) for k in range(25)]
    rows += [(300, None, None, None, None), (301, "", "en", "src1", 0), (None, say(rng, 30), "en", "src1", 11), (None, say(rng, 25), "en", None, 1)]
    rows += [(302, say(rng, 30000), "en", "src1", 1), (303, "  two  marks \n\n and ▁ one ", "en", "src1", 4), (304, " ", "en", "src1", 1), (305, "中" * 5000 + "\x01😀", "en", "s", 1)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def clash(docs):
    return docs.withColumns({c: F.lit("mine") for c in ("row", "rank", "score", "weight", "n_words", "_part", "_at", "_k0", "block", "bucket", "ids", "shard", "term", "item_id", "terms", "n")})


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def words(text):
    return TERM.findall((text or "").translate(LOWER))


# -- resampling -------------------------------------------------------------------------------


@pytest.mark.parametrize("ngrams", [1, 2])
def test_resampling_matches_brute_force(spark, docs, clash, ngrams):
    goal = spark.createDataFrame([(0, "the cat runs over water"), (1, None), (2, "")], "item_id long, text string")
    rows, n_buckets = rows_of(docs), 97

    def counted(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % n_buckets for n in range(1, ngrams + 1) for k in range(len(w) - n + 1)]

    raw, target = Counter(b for _, t in rows for b in counted(t)), Counter(b for t in ("the cat runs over water",) for b in counted(t))
    s, t = sum(raw.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s + n_buckets) / ((raw[b] + 1) * (t + n_buckets)))) for b in range(n_buckets)]
    want = []
    for doc, text in rows:
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in counted(text))
        want.append([doc, len(counted(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20])
    able = sorted((r for r in want if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranked = [(*r[:4], k + 1) for k, r in enumerate(able[: 30 * len(able) // 100])]
    found = importance.resample(clash, goal, share=(30, 100), ngrams=ngrams, buckets=n_buckets).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(tuple(r[:4]) for r in want) == Counter(tuple(r)[:4] for r in found)
    assert sorted(ranked, key=lambda r: r[4]) == sorted((tuple(r) for r in found if r["rank"]), key=lambda r: r[4])


def test_radix_selection_of_any_longs(spark):
    rng = random.Random(1)
    low, high = -(1 << 63), (1 << 63) - 1
    values = [rng.choice([low, high, 0, -1, 7, rng.randint(low, high), rng.randint(-70000, 70000)]) for _ in range(300)]
    ids = [rng.choice([None, rng.randint(low, high), 5]) for _ in values]
    df = spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(zip(ids, values))], "doc_id long, score long, row long")
    order = sorted(range(300), key=lambda k: (-values[k], ids[k] is None, ids[k] or 0, k))
    for k in (0, 1, 17, 120, 299, 300, 500):
        got = {r["row"]: r["rank"] for r in importance.top(df, k).collect()}
        assert len(got) == 300 and {r: n for r, n in got.items() if n} == {row: n + 1 for n, row in enumerate(order[:k])}


def test_resampling_of_nothing(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    assert importance.resample(none, docs).count() == 0
    assert importance.resample(docs, none).where("rank is not null").count() == 10 * sum(len(words(t)) >= 20 for _, t in rows_of(docs)) // 100


# -- ranked search ----------------------------------------------------------------------------


def brute_ranking(rows, items, k):
    held = [(doc, Counter(words(t))) for doc, t in rows if words(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df, out = Counter(w for _, c in held for w in c), []
    for item, text in items:
        asked, scored = set(words(text)), []
        for doc, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in asked if c[w])
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, n + 1, None if null else doc, -s) for n, (s, null, doc) in enumerate(sorted(scored)[:k])]
    return out


ITEMS = [(0, "the cat"), (1, None), (2, "nowhere"), (3, "Stone's LIGHT über; ÉCLAIR 42"), (3, "Stone's LIGHT über; ÉCLAIR 42"), (None, "中文 dog dog dog"), (5, " ".join(WORDS))]


@pytest.mark.parametrize("shard_words, grain, query_rows", [(1 << 22, 8, 512), (150, 1, 2), (700, 2, 3)])
def test_ranking_matches_brute_force(spark, docs, clash, shard_words, grain, query_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("mine"))
    found = ranking.search(ranking.index(clash, shard_words=shard_words, grain=grain), items, k=9, query_rows=query_rows)
    assert Counter(map(tuple, found.collect())) == Counter(brute_ranking(rows_of(docs), ITEMS, 9))


def test_ranking_of_nothing(spark, docs):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.search(ranking.index(none), items).count() == 0
    assert ranking.search(ranking.index(docs), items.limit(0)).count() == 0


def test_block_borders_are_the_best():
    """Every way of cutting, for short lists; none costs less."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(1, 14, 4)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        values = rng.integers(1, 100, starts[-1])
        ends = ranking.block_ends(values, starts, 2, 3, 1.5)

        def price(v, cuts):
            return sum((b - a + (b - a) % 2) * v[a:b].max() + 1.5 * v.mean() for a, b in zip([0, *cuts], cuts))

        for i, n in enumerate(sizes.tolist()):
            v, edges = values[starts[i] : starts[i + 1]], list(range(2, n, 2))
            ways = [[e for j, e in enumerate(edges) if bits >> j & 1] + [n] for bits in range(1 << len(edges))]
            ways = [w for w in ways if all(b - a <= 6 for a, b in zip([0, *w], w))]
            assert ends[i][-1] == n and math.isclose(price(v, ends[i]), min(price(v, w) for w in ways))


def test_variable_blocks_skip_postings():
    """Of a rare and a frequent term, most blocks of the frequent one are never read."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n = 20000
    common, rare = np.arange(n), np.sort(rng.choice(n, 300, False))
    rows = [{"term": b"", "weight": 0, "queries": [], "ids": list(range(n)), "docs": None, "impacts": None, "ends": None, "peaks": None}]
    for term, docs, weight in ((b"a", common, 10), (b"b", rare, 9000)):
        value = (1 + 900 * rng.random(len(docs)) ** 8).astype(np.int64)  # few are high
        ends = np.array(ranking.block_ends(value, np.array([0, len(docs)]), 8, 16, 16.0)[0])
        peaks = np.maximum.reduceat(value, np.concatenate([[0], ends[:-1]]))
        packed = {c: x.astype("<u4").tobytes() for c, x in (("docs", docs), ("impacts", value), ("ends", ends), ("peaks", peaks))}
        rows.append({"term": term, "weight": weight, "queries": [{"row": 0, "item_id": 0}], "ids": None, **packed})
        if term == b"a":
            score = 10 * value
        else:
            score[docs] += 9000 * value
    shard = ranking.Shard(pa.Table.from_pylist(rows))
    found, points = shard.search(0, 10)
    want = np.lexsort((np.arange(n), -score))[:10]
    assert found.tolist() == want.tolist() and points.tolist() == score[want].tolist()
    assert shard.read < n // 2


# -- SentencePiece ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("block_words, buckets", [(1 << 22, None), (40, 3)])
def test_pieces_match_the_library(spark, docs, clash, library, block_words, buckets):
    found = pieces.decode(pieces.encode(clash, MODEL, block_words, buckets), MODEL)
    want = [(doc, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for doc, t in rows_of(docs)]
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in found.collect()) == Counter(want)
    assert pieces.encode(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("a b▁\n\tThe é中😀\x00<s>0x　"), max_size=30) | st.text(max_size=40))
def test_marked_words_match_the_library(text):
    model = pieces.load_model(MODEL)
    text = text.encode("utf-8", "ignore").decode()
    assert pieces.separable(MODEL) and pieces.lines_apart(MODEL)
    for lines in (False, True):
        assert [i for ids in pieces.segment(model, pieces.marked_words(text, lines), lines) for i in ids] == model.encode(text)


def test_each_distinct_word_is_segmented_once(spark, docs, monkeypatch):
    blocks = pieces.blocks_of(docs, MODEL, 40, 3).where(F.col("bucket") != pieces.TEXTS).orderBy("bucket").collect()
    words_, model, asked = {w for r in blocks for w in pieces._unpack_words(r["data"], r["n"])}, pieces.load_model(MODEL), Counter()
    assert {w for _, t in rows_of(docs) for w in pieces.marked_words(t or "", True)} == {w.decode() for w in words_}
    whole = spark.createDataFrame(blocks, pieces.SCHEMA).coalesce(1)
    import pyarrow as pa

    real = pieces.segment
    monkeypatch.setattr(pieces, "segment", lambda m, w, lines: (asked.update(w), real(m, w, lines))[1])
    run = {}
    monkeypatch.setattr(type(whole), "mapInArrow", lambda self, f, schema: run.setdefault("f", f))
    pieces.word_ids(whole, MODEL)
    list(run["f"]([pa.Table.from_pylist([r.asDict()], schema=pieces.ARROW).to_batches()[0] for r in blocks]))
    assert model and set(asked.values()) == {1} and len(asked) == len(words_)
