"""The corpus operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import common, langid, maxscore, mixing, mixlm, packing, quality, registry, sharding, simhash, spans, suffixes
from quillon.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and cat dog runs sees big red blue house tree water stone light over under near far old".split()


def say(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, nulls in every column, an empty and a long text, a repeated row."""
    rng = random.Random(5)
    base = [say(rng, rng.randint(1, 160)) for _ in range(60)]
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src0", "src1", None]), len(t)) for k, t in enumerate(base)]
    rows += [(100 + k, base[k % 7], "en", "src0", None) for k in range(20)]
    near = base[10].split()
    for k in range(6):
        w = list(near)
        w[k % max(1, len(w))] = "changed"
        rows.append((200 + k, " ".join(w), "fr", "src2", 3))
    rows += [(300, None, None, None, None), (301, "", "en", "src1", 0), (None, "lonely text", "en", "src1", 11), (302, say(rng, 20000), "en", "src1", 1), (303, " \n\t ", "en", "src1", 4)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def clash(docs):
    """The same rows with columns named like the operators' own."""
    return docs.withColumns({c: F.lit("mine") for c in ("fp", "name", "row", "key", "doc", "copies", "budget", "slot", "kept", "label", "size", "_row", "gone", "anomaly", "epochs")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


# -- mixing -----------------------------------------------------------------------------------


def deal(total, nodes):
    """Budget of each (name, weight, capacity) by raising a common level step by step, exact."""
    out, open_ = {}, sorted(nodes, key=lambda n: (n[2] / n[1], n[0]))
    left, weights = total, sum(n[1] for n in nodes)
    level = None
    for k, (name, w, cap) in enumerate(open_):
        if level is None and cap <= left / weights * w:
            out[name] = cap
            left, weights = left - cap, weights - w
        else:
            level = left / weights if level is None else level
            out[name] = min(cap, int(math.floor(level * w + 1e-6)))
    return out


def test_mixing_matches_brute_force(spark, docs, clash):
    domain, weights = registry.mixture()
    found = mixing.mix(clash, domain, weights).select("doc.doc_id", *mixing.LEVELS, "n_tokens", "copies").collect()
    assert len(found) == docs.count()
    tokens = Counter()
    for r in found:
        tokens[r["domain"], r["lang"], r["source"]] += r["n_tokens"]
    w_domain, w_lang = {"d0": 400, "d1": 300, "d2": 200}, {"en": 500, "fr": 200, "de": 200, "es": 100}
    total = sum(tokens.values())
    cap = lambda *p: 2 * sum(n for leaf, n in tokens.items() if leaf[: len(p)] == p)
    budget = {}
    for d, b in deal(total, [(d, w_domain.get(d, 100), cap(d)) for d in {x[0] for x in tokens}]).items():
        for lang, c in deal(b, [(x, w_lang.get(x, 50), cap(d, x)) for x in {x[1] for x in tokens if x[0] == d}]).items():
            for s, e in deal(c, [(x, 1, cap(d, lang, x)) for x in {x[2] for x in tokens if x[:2] == (d, lang)}]).items():
                budget[d, lang, s] = e
    import hashlib

    for leaf, b in budget.items():
        mine = [r for r in found if (r["domain"], r["lang"], r["source"]) == leaf]
        full = b // tokens[leaf] if tokens[leaf] else 0
        rest, at = b - full * tokens[leaf], 0
        key = lambda r: (hashlib.md5(f"17:{full}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["n_tokens"])
        for k in sorted({key(r) for r in mine}):
            same = [r for r in mine if key(r) == k]
            n = sum(r["n_tokens"] for r in same)
            assert all(r["copies"] == full + (2 * at + n <= 2 * rest) for r in same)
            at += n


def test_mixed_rows_keep_columns(spark, docs, clash):
    domain, weights = registry.mixture()
    out = mixing.mixed_rows(clash, domain, weights)
    assert out.columns == clash.columns and out.count() > 0
    assert mixing.mixed_rows(empty(spark), domain, weights).count() == 0


# -- quality ----------------------------------------------------------------------------------


def brute_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen, inside, lines, dup = Counter(tri), set(), set(), 0
    for k, x in enumerate(tri):
        if seen[x] > 1:
            inside |= {k, k + 1, k + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


@pytest.mark.parametrize("text", ["", " ", "a", "a a a a", "é|# b\nx\nx\n\n\nx", "q\x0bw\x1ce\xa0r  t", "one two three one two three"])
def test_quality_statistics(text):
    assert quality.statistics(text.encode())[:5] == brute_statistics(text)


def test_quality_rejects_what_labels_call_bad(spark):
    rng = random.Random(1)
    long = [f"{a}{b}" for a in WORDS for b in WORDS]
    rows = [(k, say(rng, 120, long), None, None, None) for k in range(300)]
    rows += [(1000 + k, " ".join(f"{rng.choice(long)}###" for _ in range(120)), None, None, None) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int(k < 1000), 0) for k, *_ in rows if k is not None and k % 2 == 0], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.judge(common.materialize(quality.rule_statistics(docs), "t"), labels).collect()}
    assert sum(out[k]["kept"] for k in range(300)) >= 295
    assert sum(out[1000 + k]["kept"] for k in range(60)) <= 3


def test_forest_scores_match_a_walk_of_its_trees():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).round(1)
    forest = quality.Forest(x[:200], x, trees=12, rows=64, seed=3)
    for row in [*x[:60], np.full(4, 9.0)]:
        total = 0.0
        for t in range(12):
            node, depth = 1, 0
            while (f := forest.feature[t, node]) >= 0:
                node, depth = 2 * node + int(row[f] >= forest.value[t, node]), depth + 1
            assert depth <= forest.depth and forest.path[t, node] >= depth
            total += forest.path[t, node]
        assert abs(forest.score(row[None])[0] - 2.0 ** -(total / 12 / quality.mean_path(64))) < 1e-12
    assert forest.score(np.full((1, 4), 9.0))[0] > np.quantile(forest.score(x), 0.95)
    # each tree splits its rows: path lengths are depths plus what the rows left in a leaf would need
    one = quality.Forest(x[:1], x[:1], trees=2, rows=8, seed=0)
    assert (one.feature == -1).all() and one.score(x[:3]).tolist() == [1.0] * 3


def test_threshold_separates_all_labelled_rows_best(spark):
    rng = random.Random(2)
    long = [f"{a}{b}" for a in WORDS for b in WORDS]
    rows = [(k, say(rng, 100, long)) for k in range(120)] + [(500 + k, " ".join(rng.choice(long) + rng.choice(["", "###", "!!"]) for _ in range(100))) for k in range(60)]
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows if i % 3], "doc_id long, quality int, toxic int")
    out = quality.judge(common.materialize(quality.rule_statistics(spark.createDataFrame(rows, "doc_id long, text string")), "t"), labels, bins=50, max_good_loss=0.02).collect()
    good, bad = ([int(r["anomaly"] * 50) for r in out if r["doc_id"] % 3 and (r["doc_id"] < 500) == g] for g in (True, False))
    share = lambda xs, k: sum(x >= k for x in xs) / len(xs)
    best = max((k for k in range(50) if share(good, k) <= 0.02), key=lambda k: (share(bad, k) - share(good, k), -k))
    assert share(bad, best) > 0.5 and all(r["kept"] == (int(r["anomaly"] * 50) < best) for r in out if not r["base_failed"])


def test_quality_edges(spark, docs, clash):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(clash, labels)
    assert kept.columns == clash.columns
    expect = sorted(t for _, t in rows_of(docs) if t and not (brute_statistics(t)[0] < 50 or 100 * brute_statistics(t)[4] > 50 * brute_statistics(t)[0]))
    assert sorted(r["text"] for r in kept.collect()) == expect
    assert quality.keep_good(empty(spark), labels).count() == 0


# -- packing ----------------------------------------------------------------------------------


def test_packing_round_trip(spark, clash):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = [(900, "It's  two   blanks\n\n tail é中퟿ don't 123 !?  "), (901, "a" * 3000), (902, "x" + " " * 5000 + "y" + "\n" * 9000 + " z"), (903, "\t" * 4097)]
    mark = "<|endoftext|>"
    odd += [(904, f"{mark}a {mark}{mark} mid{mark}dle  {mark}\n{mark}"), (905, mark), (906, f"x {mark[:-1]} {mark[1:]} <|{mark}|>")]
    rows = clash.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    pieces = packing.pack(rows, path, capacity=64, block_tokens=4096).collect()
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows_of(rows))
    assert Counter(p["doc_tokens"] for p in pieces if p["start"] == 0) == Counter(len(ids) for (_, ids), n in want.items() for _ in range(n))
    at, sequences = Counter(), {}
    for p in pieces:
        ids = tuple(np.frombuffer(p["token_ids"], "<u4").tolist())
        assert len(ids) == p["length"]
        same = [k for k in want if k[0] == p["doc_id"] and len(k[1]) == p["doc_tokens"] and k[1][p["start"] : p["start"] + len(ids)] == ids]
        assert same
        at[same[0]] += len(ids)
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert at == Counter({k: n * len(k[1]) for k, n in want.items()})
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 64
    tokens = sum(len(ids) * n for (_, ids), n in want.items())
    assert len(sequences) * 64 - tokens < 64 * (rows.rdd.getNumPartitions() * 3 + tokens // 4096 + 1)


def test_long_white_space_is_encoded_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder, rng = Tokenizer.from_file(path), packing.load_encoder(path), random.Random(4)
    texts = [f"a{gap * (n // len(gap))}{tail}" for gap, n in ((" ", 2_000_000), ("\n", 2_000_000), (" \n", 9000), ("\u3000", 5000)) for tail in ("", "b", " b", "\n1")]
    texts += ["".join(rng.choice(" \n\t\xa0\r") * rng.choice([1, 2, 5000]) + rng.choice(["a", "b1", "!", " c", ""]) for _ in range(6)) for _ in range(20)]
    for text in texts:
        assert packing.encode(encoder, text, packing.added_tokens(path)) == tokenizer.encode(text, add_special_tokens=False).ids


def brute_balance(lengths, capacity, linear, quadratic):
    n = -(-sum(lengths) // capacity)
    room, cost, parts = [capacity] * n, [0.0] * n, [[] for _ in range(n)]
    worth = lambda m: linear * m + quadratic * m * m
    todo = sorted((-worth(m), i, 0, m) for i, m in enumerate(lengths) if m)
    while todo:
        _, i, begin, m = todo.pop(0)
        fits = [k for k in range(n) if room[k] >= m] or [k for k in range(n) if room[k] == max(room)]
        k = min(fits, key=lambda k: (cost[k], k))
        take = min(m, room[k])
        parts[k].append((i, begin, take))
        room[k] -= take
        cost[k] += worth(take)
        if take < m:
            todo = sorted([*todo, (-worth(m - take), i, begin + take, m - take)])
    return parts, cost


def test_packing_balances_cost():
    """The cheapest sequence with room takes each piece; pieces are cut only where none has room."""
    rng = random.Random(7)
    for most in (5, 50, 120):
        for _ in range(60):
            lengths = [rng.randint(0, most) for _ in range(rng.randint(0, 60))]
            assert packing.balance(lengths, 50, 1.0, 1 / 50) == brute_balance(lengths, 50, 1.0, 1 / 50)
    parts, cost = packing.balance([60, 30, 30, 20, 20, 20, 20], 100, 1.0, 0.01)
    assert sorted(sum(n for *_, n in p) for p in parts) == [100, 100] and max(cost) - min(cost) < 0.2 * max(cost)
    assert packing.balance([], 10, 1, 1) == ([], [])


def test_packing_empty(spark):
    assert packing.pack(empty(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# -- sharding ---------------------------------------------------------------------------------


def test_sharding_is_exact_and_gapless(spark, docs, clash):
    out = sharding.shard(clash, shards=7, virtual=16).collect()
    counts = Counter(r["shard"] for r in out)
    assert len(out) == docs.count() and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 7
    for s, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    same = sharding.shard(spark.range(3000).select(F.lit(5).alias("doc_id"), F.lit("x").alias("text")), shards=7, virtual=16).collect()  # one key
    assert sorted(Counter(r["shard"] for r in same).values()) == [428, 428, 428, 429, 429, 429, 429]
    assert all(sorted(r["slot"] for r in same if r["shard"] == s) == list(range(428 + (s < 4))) for s in range(7))
    text = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows_of(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == text
    assert sharding.shard(empty(spark)).count() == 0


def test_walk_agrees_with_one_row_at_a_time():
    points = sharding.ring(5, 8, 3)
    rng = random.Random(2)
    counts = {a: rng.randint(0, 9) for a in range(len(points))}
    room = sharding.capacities(sum(counts.values()), 5, 0.0)
    left, expect = list(room), []
    for arc in range(len(points)):
        for _ in range(counts[arc]):
            at = arc
            while not left[points[at % len(points)][1]]:
                at += 1
            s = points[at % len(points)][1]
            expect.append((arc, s, room[s] - left[s]))
            left[s] -= 1
    got = [(arc, s, slot + k) for arc, lo, hi, s, slot in sharding.walk(points, counts, room) for k in range(hi - lo)]
    assert got == expect


def test_sharding_moves_little(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    place = lambda n: {r["doc_id"]: r["shard"] for r in sharding.shard(ids, shards=n, slack=0.1).collect()}
    a, b = place(8), place(9)
    assert sum(a[k] != b[k] for k in a) < 0.4 * 4000


# -- language ---------------------------------------------------------------------------------


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(4)
    line = bytes(rng.randint(1, 3) for _ in range(40))
    step = langid.suffix_automaton(line)
    for n in range(1, 7):
        for _ in range(60):
            q, at = bytes(rng.randint(1, 3) for _ in range(n)), 0
            for c in q:
                at = step[at].get(c, -1) if at >= 0 else -1
            assert (at >= 0) == (q in line)


def greedy(text, held):
    n, k = 0, 0
    while k < len(text):
        m = 1
        while k + m < len(text) and text[k : k + m + 1] in held:
            m += 1
        n, k = n + 1, k + m
    return n


@pytest.mark.parametrize("block", [1, 7, 64, 1024])
def test_phrases_are_greedy_longest_matches(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(2)
    wide = "".join(chr(0x4E00 + k) for k in range(500)) + "".join(chr(0x20000 + k) for k in range(80))
    samples = ["abracadabra abra", "the cat sat on the mat", "".join(rng.choice("ab ") for _ in range(400)), "".join(rng.choice(wide) for _ in range(3000)), "ab" * 300]
    texts = ["", "abra the cadabra zqz mat cats", "".join(rng.choice("abc ") for _ in range(3000)), "".join(rng.choice(wide + "q") for _ in range(900)), "ab" * 700, "b"]
    known = langid.Parser(tuple((f"l{k}", s) for k, s in enumerate(samples)))
    coded = [known.symbol[np.frombuffer(t.encode(), np.uint8)] for t in texts]
    assert known.phrases(coded).tolist() == [[greedy(t.encode(), s.encode()) for t in texts] for s in samples]


def test_languages_of_a_wide_script(spark):
    """Two languages that share no more than a script of 3,000 signs; the signs are no letters of any other."""
    rng = random.Random(6)
    words = [["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2)) for _ in range(200)] for _ in range(2)]
    rows = [(k, "".join(rng.choice(words[k % 2]) for _ in range(150)), ("ja", "zh")[k % 2]) for k in range(100)]
    rows += [(200 + k, say(rng, 100), "en") for k in range(30)]
    train = common.crc32_of_id(F.col("doc_id")) % 4 != 2
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in out} == {k: x for k, _, x in rows}


def test_a_language_of_one_huge_text(spark):
    """Two million characters and no shorter text: the sample is bounded, from the whole length, and told apart from the other language."""
    rng = random.Random(9)
    part = lambda syllables: "".join(rng.choice(syllables) + rng.choice(["", "", " "]) for _ in range(40))
    huge = "".join(f"{part(['ba', 'bo', 'lu', 'ma'])} " for _ in range(25_000))
    rows = [(0, huge, "one")] + [(k, part(["ti", "re", "ke", "su"]), "two") for k in range(1, 30)] + [(100 + k, part(["ba", "bo", "lu", "ma"]), None) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = dict(langid.sample(df, 64, 1 << 15, 1 << 18))
    assert len(huge) > 1_900_000 and 1 << 16 < len(found["one"]) <= 1 << 17
    pieces = found["one"].split(langid.BORDER)
    places = [langid.normal(huge).index(p) for p in pieces]
    assert places == sorted(places) and places[0] < len(huge) / 5 and places[-1] > len(huge) * 4 / 5
    assert langid.Parser(tuple(found.items())).table.nbytes < 64 << 20
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, F.col("lang").isNotNull()).collect()}
    assert all(out[k] == "one" for k in (0, *range(100, 120))) and all(out[k] == "two" for k in range(1, 30))


def test_language_sample_is_bounded_and_whole(spark):
    """One id repeated 100,000 times is learned once, null ids like any other; texts are whole, long ones only where nothing else is."""
    kind = "doc_id long, text string, lang string"
    many = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("uno dos tres").alias("text"), F.lit("es").alias("lang"))
    rows = [(None, "ett tva tre", "sv"), (None, "fyra fem", "sv"), (1, "x" * 500 + " ja", "fi"), (2, "y" * 400, "fi"), (3, "12 34", "xx"), (4, None, "yy"), (5, "no language", None)]
    rows += [(100 + k, f"word{chr(97 + k % 26)}{'abc' * 20}", "en") for k in range(40)] + [(99, "z" * 5000, "en")]
    found = dict(langid.sample(many.unionByName(spark.createDataFrame(rows, kind)), 8, 300, 1 << 20))
    assert set(found) == {"en", "es", "fi", "sv"} and found["es"] == "uno dos tres" and found["fi"] == "y" * 400
    assert sorted(found["sv"].split("\n")) == ["ett tva tre", "fyra fem"]
    parts = found["en"].split("\n")
    assert len(parts) == 4 and all(len(p) == 65 for p in parts)
    assert langid.sample(spark.createDataFrame(rows, kind).where("lang = 'xx'"), 8, 300, 1 << 20) == ()


def test_language_held_out_and_edges(spark, docs, clash):
    rng = random.Random(3)
    tongue = {"aa": "bo ba bi ma mo mi".split(), "zz": "kra tsk grz vlk prst".split()}
    rows = [(k, say(rng, 60, tongue[("aa", "zz")[k % 2]]), ("aa", "zz")[k % 2], "s", 1) for k in range(120)]
    rows += [(500, None, "aa", None, None), (501, "12 34 !?", "aa", None, None), (502, "", None, None, None)]
    train = common.crc32_of_id(F.col("doc_id")) % 4 != 2
    out = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA), train).collect()}
    assert all(out[k]["lang_pred"] == ("aa", "zz")[k % 2] and 0 <= out[k]["score"] <= 1 for k in range(120))
    assert {out[k]["lang_pred"] for k in (500, 501, 502)} == {"und"}
    assert langid.identify(clash, train).count() == docs.count()
    assert langid.identify(empty(spark), train).count() == 0


# -- simhash ----------------------------------------------------------------------------------


def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))


def brute_components(fps, radius):
    label = list(range(len(fps)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(k) for k in range(len(fps))]


def test_simhash_matches_brute_force(spark, docs, clash):
    rows = [(i, t) for i, t in rows_of(docs)]
    named = [(i, t) for i, t in rows if i is not None]
    fps = [brute_fingerprint(t) for _, t in named]
    tops, least = brute_components(fps, 2), {}
    for (i, _), k in zip(named, tops):
        least[k] = min(i, least.get(k, i))
    want = Counter((i, f"{f:016x}", least[k]) for (i, _), f, k in zip(named, fps, tops))
    out = simhash.near_duplicates(clash).select("doc_id", F.lower(F.hex("fp")).alias("f"), "component_id").collect()
    assert Counter((r["doc_id"], r["f"], r["component_id"]) for r in out if r["doc_id"] is not None) == want
    assert len(out) == len(rows)
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("bits,radius,blocks,band", [(64, 2, 4, 1), (64, 2, 1, 1), (128, 20, 1, 8), (64, 5, 2, 4)])
def test_tiles_lose_no_link(spark, bits, radius, blocks, band):
    rng = random.Random(bits + radius)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(bits)
        for _ in range(12):
            fps.add(f)
            for _ in range(rng.randint(0, radius)):
                f ^= 1 << rng.randrange(bits)
    fps = sorted(fps)
    table = spark.createDataFrame([(bytearray(f.to_bytes(bits // 8, "big")), k) for k, f in enumerate(fps)], "fp binary, name long")
    edges = simhash.tile_links(table, bits, radius, blocks, band, tile_rows=16)
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    want = brute_components(fps, radius)
    assert [got.get(k, k) for k in range(len(fps))] == want
    assert edges.count() <= 40 * len(fps)


def test_one_row_of_each_group_stays(spark, docs, clash):
    out = simhash.drop_near_duplicates(clash)
    assert out.columns == clash.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and {0, 1, 2}.issubset(ids) and not set(ids) & set(range(100, 120))
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("cell_rows", [512, 8])
def test_near_duplicates_are_those_of_the_sets(spark, cell_rows):
    rng = random.Random(3)
    bases = [[f"{rng.choice(WORDS)}{rng.randint(0, 10**6)}" for _ in range(120)] for _ in range(40)]
    rows = []
    for b, base in enumerate(bases):
        for k in range(5):
            w = list(base)
            for at in rng.sample(range(5, 115), rng.randint(0, 9)):
                w[at] = f"new{rng.randint(0, 10**6)}"
            rows.append((10 * b + k, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    want = {rows[k][0] for k in label}
    assert len(bases) < len(want) < len(rows)
    table = spark.createDataFrame(rows + [(None, rows[0][1]), (None, "a b"), (None, "a b")], "doc_id long, text string")
    out = [r["doc_id"] for r in simhash.drop_near_duplicates(table, cell_rows=cell_rows).collect()]
    assert Counter(out) == Counter([*want, None])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 199), (5, 5)], "a long, b long")
    out = {r["node"]: r["label"] for r in components(edges).collect()}
    assert all(out[k] == 0 for k in range(61)) and out[200] == out[199] == 199


# -- top k ------------------------------------------------------------------------------------


def test_maxscore_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(size=8).round(2)]) for k in range(300)]
    rows += [(k + 300, rows[k][1]) for k in range(40)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [0.5, 0.5]), (405, []), (None, [1.0] * 8), (50, rows[7][1]), (50, rows[50][1])]
    vectors = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = {}
    for block_rows, query_rows in ((64, 3), (16, 100)):
        got = Counter()
        for r in maxscore.search(vectors, "id % 50 = 0", 5, block_rows=block_rows, query_rows=query_rows).collect():
            got[r["query_id"], r["rank"], r["vec_id"], r["score"]] += 1
        good = [(k, [math.floor(256 * x) for x in v]) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
        want = Counter()
        for at, (q, v) in enumerate(good):
            if q % 50 == 0:
                score = sorted((-sum(a * b for a, b in zip(v, w)), k) for j, (k, w) in enumerate(good) if j != at)[:5]
                want.update((q, n + 1, k, -s) for n, (s, k) in enumerate(score))
        assert got == want
    assert maxscore.search(vectors.where("id < 0"), "id % 50 = 0", 5).count() == 0


def test_maxscore_parts_and_clashing_columns(spark):
    """Every part meets every query block, however many blocks it has; columns named like the operator's own are ignored."""
    rows = [(k, [float((k * 7 + j * j) % 11) for j in range(4)], "x", k) for k in range(120)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>, part string, block int").repartition(5)
    want = maxscore.search(vectors.select("id", "v"), "id % 10 = 0", 3).collect()
    for options in ({"block_rows": 4, "query_rows": 2, "part_blocks": 1}, {"block_rows": 3, "query_rows": 5, "part_blocks": 50}):
        got = maxscore.search(vectors, "id % 10 = 0", 3, **options).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(got) == 36


def test_maxscore_huge_components(spark):
    rows = [(0, [1e9, -1e9]), (1, [1e9, 3.0]), (2, [-1e9, 1e300])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    out = maxscore.search(v, "id = 0", 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [1, 2] and out[1]["score"] == -(1 << 63)


# -- language model ---------------------------------------------------------------------------


def test_scores_and_base(spark, docs, clash):
    train = common.crc32_of_id(F.col("doc_id")) % 7 != 2
    out = mixlm.score(clash, train, label="lang", sample_rows=20, head_words=8).collect()
    texts, counts = rows_of(docs), Counter()
    learned = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"]
    for i, t in texts:
        if learned(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        w = tokens(t)
        want[i, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert mixlm.score(empty(spark), train).count() == 0


def test_token_probabilities_are_proper():
    """Over all continuations of any place the coded probabilities add up to one."""
    code = mixlm.prefix_code(np.bincount(np.frombuffer(b"ab abc b \n", np.uint8), minlength=256))
    rng = np.random.default_rng(0)
    model = mixlm.Model(rng.integers(0, 9, mixlm.SLOTS).astype(np.uint16) + rng.integers(0, 9, mixlm.SLOTS).astype(np.uint16) * 256, code)
    assert [mixlm.LEVELS[k] for k in mixlm.as_levels(np.array([0, 1, 77, 128]))] == [0, 1, 77, 128] and abs(mixlm.LEVELS[mixlm.as_levels(10**9)] / 10**9 - 1) < 0.13
    weights, hits, total = model.weights.copy(), np.zeros(mixlm.GATES * mixlm.CELLS), np.zeros(mixlm.GATES * mixlm.CELLS)
    model.fit([b"ab", b"abc", b"b", mixlm.END] * 50, np.zeros(200, np.int64), np.full(200, 3), weights, hits, total)
    assert not np.allclose(weights, model.weights)
    model.settle([(weights, hits, total)])
    first = [bytes([c]) for c in range(256) if c != 10]
    cost = model.bits(first, np.zeros(len(first), np.int64))
    alone = []  # the cost of the first byte: of each word that is one byte and a space, less that of the space behind it
    for slots, bit, place, token in mixlm.pieces(first, np.zeros(len(first), np.int64), code):
        zeros, ones = (mixlm.LEVELS[c] for c in (model.counts[slots] & 255, model.counts[slots] >> 8))
        gate = place + mixlm.PLACES * sum((zeros + ones)[mixlm.WORD] > k for k in (0, 12))
        one = mixlm.refine(mixlm.mixed_odds(np.log((ones + mixlm.PRIOR) / (zeros + mixlm.PRIOR)), gate, model.weights), gate, model.table)
        p = np.where(bit, one, 1 - one)
        for t in range(len(first)):
            alone.append(float(np.prod(p[(token == t) & (place == 0)])))
    end = 2.0 ** -model.bits([mixlm.END], np.zeros(1, np.int64))[0]
    assert abs(sum(alone) + end - 1) < 1e-3 and len(cost) == 255


def test_what_a_text_says_is_a_distribution():
    """x adds up to 1 - y over the words seen so far, at each place; words not seen have none."""
    rng = random.Random(3)
    for _ in range(40):
        text = [rng.randrange(4) for _ in range(rng.randint(1, 25))]
        before = [rng.randrange(4) for _ in range(rng.randint(1, 9))]  # another text, in one go with it
        n, m = len(before), len(text) + 1
        last = [[c[-1] for c in mixlm.told(np.array([*before, *text, w]), np.repeat([0, 1], [n, m]), np.repeat([0, n], [n, m]))] for w in range(5)]
        assert len({round(y, 12) for _, y in last}) == 1 and abs(sum(x for x, _ in last) + last[0][1] - 1) < 1e-9
        assert last[4][0] == 0.0


def test_scores_match_a_brute_force_coder(spark, docs):
    """Counters, probabilities and sums of a small table, one occurrence at a time."""
    train = common.crc32_of_id(F.col("doc_id")) % 7 != 2
    slim = docs.where("doc_id is null or doc_id <> 302").select("doc_id", "text", F.col("lang").alias("label"), train.alias("learn"))
    hints, model, words = mixlm.learn(slim, 20, 64)
    held = {bytes(r["word"]): (r["n"], r["p"]) for r in words.collect()}
    rows = slim.collect()

    def classed(tokens):
        now, out = 0, []
        for w in tokens:
            out.append((w, now))
            now = hints.get(w, now)
        return out

    coded = [(classed([*(r["text"] or "").encode().lower().split(), mixlm.END]), r["learn"]) for r in rows]
    zeros, ones = Counter(), Counter()
    n, by_class = Counter(), Counter()
    for tokens, counted in coded:
        for w, k in tokens if counted else ():
            n[w, k] += 1
            by_class[k] += 1
            for slots, bit, _, _ in mixlm.pieces([w], np.array([k]), model.code):
                for row in slots:
                    zeros.update(row[bit == 0].tolist())
                    ones.update(row[bit == 1].tolist())
    for counted, table in zip((zeros, ones), (model.counts & 255, model.counts >> 8)):
        assert {k: int(table[k]) for k in np.nonzero(table)[0].tolist()} == {k: int(mixlm.as_levels(n)) for k, n in counted.items()}
    zeros, ones = (Counter({k: mixlm.LEVELS[mixlm.as_levels(n)] for k, n in c.items()}) for c in (zeros, ones))
    trust = {}
    for (w, k), m in n.items():
        bits = sum(
            -math.log2(p if b else 1 - p)
            for slots, bit, place, _ in mixlm.pieces([w], np.array([k]), model.code)
            for j, b in enumerate(bit.tolist())
            for seen in [zeros[slots[mixlm.WORD, j]] + ones[slots[mixlm.WORD, j]]]
            for gate in [place[j] + mixlm.PLACES * ((seen > 0) + (seen > 12))]
            for odds in [[math.log((ones[slots[q, j]] + mixlm.PRIOR) / (zeros[slots[q, j]] + mixlm.PRIOR)) for q in range(len(mixlm.WIDTHS))]]
            for mixed in [max(-mixlm.CLIP, min(mixlm.CLIP, sum(o * float(v) for o, v in zip(odds, model.weights[:, gate]))))]
            for cell in [gate * mixlm.CELLS + int((mixed + mixlm.CLIP) * (mixlm.CELLS - 1) / (2 * mixlm.CLIP) + 0.5)]
            for p in [0.5 * (1 / (1 + math.exp(-mixed)) + float(model.table[cell]))]
        )
        share, p = m / by_class[k], held[w][1][k]
        if abs(share - 2.0**-bits) > 0.02:  # the weight of the two parts, one for each class
            t = (p - 2.0**-bits) / (share - 2.0**-bits)
            assert 0 <= t <= 1 and abs(t - trust.setdefault(k, t)) < 0.01
    want = Counter()
    for r, (tokens, _) in zip(rows, coded):
        bits, seen, pairs = 0.0, [], []
        (a, b), (c, d) = mixlm.ASKED, mixlm.ASKED
        for w, k in tokens:
            p = held[w][1][k]
            if seen:
                t = mixlm.TRUST * a / b
                p = t * seen.count(w) / len(seen) + (1 - t) * p
                a, b = a + (w in seen), b + 1
                after = [y for x, y in pairs if x == seen[-1]]
                if after:
                    t = mixlm.TRUST * c / d
                    p = t * after.count(w) / len(after) + (1 - t) * p
                    c, d = c + (w in after), d + 1
                pairs.append((seen[-1], w))
            seen.append(w)
            bits -= math.log2(p)
        want[r["doc_id"], len(tokens), round(-bits * math.log10(2), 3)] += 1
    out = mixlm.score(slim.withColumnRenamed("label", "lang"), F.col("learn"), label="lang", sample_rows=20, hint_words=64, head_words=8).collect()
    assert Counter((r["doc_id"], r["n_tokens"], round(r["score"], 3)) for r in out) == want


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Weights are fitted in runs that hashes choose: other partitions of the rows and of shuffles change no score."""
    rng = random.Random(4)
    rows = [(k, say(rng, 60, [a + b for a in "abcdefgh" for b in ("an", "on", "ush", "eld")]), "aa", None, None) for k in range(90)]
    train, before = common.crc32_of_id(F.col("doc_id")) % 7 != 2, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(mixlm, "RUN", 8)
    found = []
    try:
        for parts in (4, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            out = mixlm.score(spark.createDataFrame(rows, SCHEMA).repartition(parts, "text"), train, label="lang", sample_rows=60).collect()
            found.append({r["doc_id"]: r["score"] for r in out})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys() and all(abs(found[0][k] - found[1][k]) < 1e-6 for k in found[0])


def test_weights_are_carried_on_from_round_to_round(spark, monkeypatch):
    """Each run goes on from what all rounds before have learned: the weights of one pass made here, run by run."""
    monkeypatch.setattr(mixlm, "RUN", 8)
    rng = random.Random(6)
    rows = sorted({("".join(rng.choices("abcde", k=rng.randint(1, 5))).encode(), rng.randrange(2)) for _ in range(40)})
    tokens = spark.createDataFrame([(w, k, rng.randint(0, 5)) for w, k in rows], "word binary, class int, n long")
    code = mixlm.prefix_code(mixlm.byte_counts(tokens))
    model, _ = mixlm.fitted(tokens, code)
    known = tokens.where("n > 0")
    runs = -(-known.count() // 8)
    assert runs >= 4 and mixlm.rounds_of(runs)[0] == (0, 1) and mixlm.rounds_of(1) == [(0, 1)] and mixlm.rounds_of(57) == [(0, 1), (1, 9), (9, 57)]
    dealt = known.withColumn("run", F.expr(f"pmod(xxhash64(word, class), {runs})")).orderBy("run", F.hash("word", "class"), "word", "class").collect()
    mine, last = mixlm.Model(model.counts, code), None
    for first, behind in mixlm.rounds_of(runs):
        parts = []
        for run in range(first, behind):
            part = [r for r in dealt if r["run"] == run]
            state = mine.weights.astype(float), np.zeros(mixlm.GATES * mixlm.CELLS), np.zeros(mixlm.GATES * mixlm.CELLS)
            if part:
                mine.fit([bytes(r["word"]) for r in part], np.array([r["class"] for r in part]), np.array([r["n"] for r in part]), *state)
                parts.append(state)
        last = mine.weights
        mine.settle(parts)
    assert np.allclose(mine.weights, model.weights, atol=1e-6) and np.allclose(mine.table, model.table, atol=1e-6)
    assert not np.allclose(last, np.full_like(last, 1 / len(mixlm.WIDTHS)))


def test_runs_are_cut_alike_however_batches_lie():
    table = pa.table({"run": [0] * 7 + [2] * 3 + [3] * 5, "word": [bytes([65 + k]) for k in range(15)], "class": list(range(15)), "n": list(range(15))})
    cut = lambda size: [(r, w, c.tolist(), n.tolist()) for r, w, c, n in mixlm.in_runs(table.to_batches(max_chunksize=size), 3)]
    assert cut(100) == cut(1) == cut(4) and [(r, len(w)) for r, w, _, _ in cut(4)] == [(0, 3), (0, 3), (0, 1), (2, 3), (3, 3), (3, 2)]


def test_model_beats_base_on_held_out(spark):
    """Two languages of disjoint words: a text's class is worth a bit a word, and unseen words have known parts."""
    rng = random.Random(8)
    make = lambda heads, tails: [a + b + c for a in heads for b in tails for c in tails]
    tongues = {"aa": make(("ka", "lo", "mi"), ("sa", "ne", "vi", "don", "gu")), "zz": make(("pr", "st", "kl"), ("ask", "orn", "ilt", "und", "erg"))}
    rows = [(k, say(rng, 80, tongues[("aa", "zz")[k % 2]]), ("aa", "zz")[k % 2], None, None) for k in range(200)]
    train = common.crc32_of_id(F.col("doc_id")) % 7 != 2
    out = mixlm.score(spark.createDataFrame(rows, SCHEMA), train, label="lang", sample_rows=60).collect()
    out = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in out) > 0.97 * sum(r["base_score"] for r in out)


# -- repeated passages ------------------------------------------------------------------------


def brute_parts(text, long_words=12, one_in=8):
    """Words of each part of a text, sentence by sentence and word by word."""
    sentences, now = [], []
    for line in text.encode().lower().split(b"\n"):
        for w in line.split():
            now.append(w)
            if w[-1:] in (b".", b"!", b"?"):
                sentences, now = [*sentences, now], []
        if now:
            sentences, now = [*sentences, now], []
    found = []
    for sentence in sentences:
        for j, w in enumerate(sentence):
            now.append(w)
            again = j > 0 and sentence[j - 1] == w or not j and found and found[-1][-1] == w
            if len(sentence) > long_words and (again or int.from_bytes(xxhash.xxh3_128_digest(w)[:8], "little") % one_in == 0):
                found, now = [*found, now], []
        if now:
            found, now = [*found, now], []
    return found


def brute_runs(found, k=2, n=6):
    """Every shortest run by its first part, and by its last."""
    ok = lambda a, b: b - a >= k and sum(map(len, found[a:b])) >= n
    runs = {(a, b) for a in range(len(found)) for b in range(a, len(found) + 1) if ok(a, b)}
    return sorted(r for r in runs if (r[0], r[1] - 1) not in runs or (r[0] + 1, r[1]) not in runs)


def brute_spans(rows, keys):
    """Words that stay of each row by the definition; ``keys``: what orders rows of one id."""
    found = {key: brute_parts(key[1] or "") for key in rows}
    first, drop = set(), {key: set() for key in rows}
    for key in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], keys[r])):
        for a, b in brute_runs(found[key]):
            line = b" ".join(b" ".join(p) for p in found[key][a:b])
            if line in first:
                drop[key] |= set(range(a, b))
            else:
                first.add(line)
    return {key: (None if key[1] is None else [w for j, p in enumerate(found[key]) if j not in drop[key] for w in p], len(drop[key])) for key in rows}


@pytest.mark.parametrize("arrow_rows", [1024, 5])
def test_sentence_spans_match_brute_force(spark, docs, clash, monkeypatch, arrow_rows):
    rng = random.Random(9)
    passage = " ".join(f"{a}{b}." if k % 6 == 5 else f"{a}{b}" for k, (a, b) in enumerate((rng.choice(WORDS), rng.choice(WORDS)) for _ in range(66)))
    unbroken = " ".join(f"{rng.choice(WORDS)}{rng.choice(WORDS)}" for _ in range(120))
    extra = [(600 + k, f"{say(rng, 15)}\n{passage}\n{say(rng, 9)} {unbroken} {say(rng, 9)}", None, None, None) for k in range(4)]
    rows = clash.where("doc_id is null or doc_id <> 302").unionByName(spark.createDataFrame(extra, SCHEMA), allowMissingColumns=True)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow_rows))
    out = spans.dedup_spans(rows).select("doc.doc_id", "text", "n_removed").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    keyed = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).collect()
    want = brute_spans([tuple(r)[:2] for r in keyed], {tuple(r)[:2]: r["key"] for r in keyed})
    words = lambda t: None if t is None else [*map(str.encode, re.findall(r"[^\x20\x09-\x0D]+", t.lower()))]
    tell = lambda i, w, n: (i, None if w is None else tuple(w), n)
    assert Counter(tell(r["doc_id"], words(r["text"]), r["n_removed"]) for r in out) == Counter(tell(r["doc_id"], *want[r["doc_id"], r["text"]]) for r in keyed)
    by = {r["doc_id"]: r for r in out}
    assert passage in by[600]["text"] and all(passage.split(". ")[2] not in by[600 + k]["text"] for k in (1, 2, 3))
    assert all(sum(w in by[600 + k]["text"] for w in unbroken.split()) < 45 for k in (1, 2, 3))
    assert spans.remove_repeated_spans(rows).columns == rows.columns
    assert spans.dedup_spans(empty(spark)).count() == 0


def test_lost_spans_of_a_batch_stay_small():
    """Many spans lost by the texts of one batch are read where they lie, and spans leave in batches of bounded size."""
    import tracemalloc

    begin = np.tile(np.arange(2_000, dtype=np.int32), 100)
    pairs = pa.StructArray.from_arrays([pa.array(begin), pa.array(begin + 2)], ["begin", "end"])
    gone = pa.ListArray.from_arrays(pa.array([0, 0, *range(2_000, 200_001, 2_000)], pa.int32()), pairs)
    tracemalloc.start()
    try:
        found = [int(spans.covered(gone, k, 2_005).sum()) for k in range(1, 101)]
        assert tracemalloc.get_traced_memory()[1] < 2_000_000  # a dict for each span took 68 MB
    finally:
        tracemalloc.stop()
    assert found == [2_001] * 100 and not spans.covered(gone, 0, 5).any() and spans.covered(gone.slice(1), 0, 2_005).sum() == 2_001
    sizes = [b.num_rows for b in spans.in_batches(((np.arange(7),) for _ in range(10)), ["x"], 20)]
    assert sizes == [21, 21, 21, 7] and list(spans.in_batches([], ["x"])) == []


@pytest.mark.parametrize("lengths", [[15, 8, 5], [40, 6], [6, 40], [45, 3, 4], [12, 12, 4, 3], [3, 4, 20, 2], [1, 1, 6], [4, 4], [3, 4], [4, 3, 2]])
def test_repeated_runs_are_covered_to_their_end(lengths):
    unique = iter(range(10**6))
    make = lambda sizes: [" ".join(f"w{next(unique)}" for _ in range(m)) + "." for m in sizes]
    passage, seen, covered = make(lengths), set(), set()
    for text in ([*make([9, 30]), *passage, *make([25, 4])] for _ in range(2)):
        words, begin, end = spans.parts("\n".join(text).encode(), 12, 8)
        flat = "\n".join(text).split()
        a, b = spans.spans(begin, end, 2, 6)
        for x, y in zip(begin[a].tolist(), end[b - 1].tolist()):
            line = tuple(flat[x:y])
            covered |= set(line) if line in seen else set()
            seen.add(line)
    assert covered == set(" ".join(passage).split())


def test_a_word_said_over_and_over_is_a_repeated_span(spark):
    rng = random.Random(2)
    rows = [(k, f"{say(rng, 20)}\nBegin {'spam ' * 400}end.", "en", "s", 1) for k in range(3)] + [(9, "Short one here.\nAnd that is all.", "en", "s", 1), (10, "Short one here.\nAnd that is all.\nMore.", "en", "s", 1)]
    out = {r["doc_id"]: r["text"] for r in spans.dedup_spans(spark.createDataFrame(rows, SCHEMA)).select("doc.doc_id", "text").collect()}
    assert out[0].count("spam") <= 12 and out[1].count("spam") <= 12 and out[2].count("spam") <= 12
    assert out[9] == rows[3][1] and out[10].strip() == "More."


def test_spans_reach_nine_tenths_of_passages(spark):
    """Words in passages of 50 that stood in a lesser doc_id, on the test tables."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("doc_id", "text")
    rows = sorted(tuple(r) for r in df.collect())
    seen, whole, hit = set(), 0, 0
    kept = {r["doc_id"]: r["text"] for r in spans.dedup_spans(df).select("doc.doc_id", "text").collect()}
    for i, t in rows:
        w = t.lower().split()
        grams = [hash(tuple(w[k : k + 50])) for k in range(len(w) - 49)]
        covered = {j for k, g in enumerate(grams) if g in seen for j in range(k, k + 50)}
        seen |= set(grams)
        whole += len(covered)
        left, stay = kept[i].lower().split(), set()
        at = 0
        for j, x in enumerate(w):  # what stays is a subsequence, told greedily
            if at < len(left) and left[at] == x:
                stay.add(j)
                at += 1
        hit += len(covered - stay)
    assert whole > 10_000 and hit >= 0.9 * whole


def test_parts_cover_the_text():
    rng = random.Random(1)
    for t in ("", "  ", "One. Two!\n\nThree", "a.b c?  d", "\n\n x", say(rng, 300).replace(".", ""), "x. " * 40):
        words, begin, end = spans.parts(t.encode(), 12, 8)
        flat = t.lower().encode().split()
        assert [flat[a:b] for a, b in zip(begin, end)] == brute_parts(t)


# -- suffixes ---------------------------------------------------------------------------------


def brute_passages(rows, n=50):
    """Words of each (id, key) in an n-word window that stood at a lesser place; ``rows``: (id, key, text)."""
    seen, covered = set(), {}
    for i, key, t in sorted({r for r in rows if r[2]}, key=lambda r: (r[0] is not None, r[0], r[1])):
        w, mine = t.encode().lower().split(), set()
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            if x in seen:
                mine.update(range(k, k + n))
            seen.add(x)
        if mine:
            covered[i, key] = mine
    return covered


def passages_of(found):
    got = {}
    for r in found.collect():
        mine = got.setdefault((r["doc_id"], r["key"]), set())
        assert not mine & set(range(r["begin"] - 1, r["end"] + 1))
        mine.update(range(r["begin"], r["end"]))
    return got


@pytest.mark.parametrize("seed,arrow_rows", [(0, 1024), (1, 4), (2, 4)])
def test_suffixes_match_brute_force(spark, seed, arrow_rows):
    """Overlapping cuts of a few texts, periodic ones, copies, and a phrase that is everywhere: no word missed or added."""
    rng = random.Random(seed)
    unique = lambda n: [f"{rng.choice(WORDS)}{rng.randint(0, 10**9)}" for _ in range(n)]
    pool, hot = [unique(150) for _ in range(3)], unique(40)
    rows = []
    for k in range(70):
        text = unique(rng.randint(0, 20))
        for _ in range(rng.randint(1, 3)):
            source, a = rng.choice(pool), rng.randint(0, 100)
            piece = source[a : a + rng.randint(10, 90)]
            text += rng.choice([piece, piece, hot, source[60:70] + hot + source[80 : 80 + rng.randint(0, 30)], ["of"] * rng.randint(10, 120)]) + unique(rng.randint(0, 9))
        rows.append((k % 50 if k % 7 else None, " ".join(text)))
    rows += rows[:6] + [(900 + k, rows[8][1]) for k in range(4)] + [(990, None), (991, ""), (992, "x y")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"key": F.lit(1), "id": F.lit("a"), "begin": F.lit(2)})
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow_rows))
    got = passages_of(suffixes.repeated_passages(table))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = brute_passages([tuple(r) for r in table.select("doc_id", F.xxhash64("doc_id", "text"), "text").collect()])
    assert got == want and len(want) > 40


def test_suffixes_find_planted_passages(spark, docs, clash):
    rng = random.Random(6)
    unique = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 10**9)}" for _ in range(n))
    passage, short = unique(60), unique(30)
    rows = [(10, f"{unique(40)} {passage} {unique(30)}"), (11, f"{unique(17)}\n{passage}\t{unique(3)}"), (12, passage), (13, unique(300)), (14, f"{short} {unique(40)}"), (15, f"{unique(40)} {short}"), (16, None), (17, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "doc": F.lit(2)})
    found = suffixes.repeated_passages(table)
    got = {r["doc_id"]: (r["begin"], r["end"], r["first_doc_id"], r["first_begin"]) for r in found.collect()}
    assert got == {11: (17, 77, 10, 40), 12: (0, 60, 10, 40)}
    cut = {r["doc_id"]: r["text"] for r in suffixes.cut_passages(table, found).collect()}
    assert cut[12] == "" and passage not in cut[11] and cut[10] == rows[0][1] and cut[13] == rows[3][1]
    assert suffixes.repeated_passages(empty(spark)).count() == 0
    rows = [tuple(r) for r in docs.select("doc_id", F.xxhash64("doc_id", "text"), "text").collect()]
    assert passages_of(suffixes.repeated_passages(clash)) == brute_passages(rows)


# -- pipeline ---------------------------------------------------------------------------------


def pipeline_rows(clash, spark):
    """Rows with every stage's work in them, and columns named like the operators' own."""
    rng = random.Random(12)
    long = [f"{a}{b}" for a in WORDS for b in WORDS]
    texts = [say(rng, 150, long) for _ in range(30)]
    rows = [(700 + k, t, ("en", "fr")[k % 2], "src1", 3) for k, t in enumerate(texts)]
    for k in range(12):  # near copies, some of them in a chain
        w = texts[k % 4].split()
        for at in rng.sample(range(150), 1 + k % 4):
            w[at] = f"new{rng.randint(0, 10**6)}"
        rows.append((800 + k, " ".join(w), "en", "src1", 3))
    passage = say(rng, 60, long)
    rows += [(900 + k, f"{say(rng, 80, long)}\n{passage}\n{say(rng, 30, long)}", "de", "src2", 3) for k in range(5)]
    rows += [(940, f"{say(rng, 120, long)} <|endoftext|> {say(rng, 40, long)}<|endoftext|>", "en", "src1", 3)]
    rows += [(950 + k, " ".join(f"{rng.choice(long)}###" for _ in range(120)), None, None, None) for k in range(8)]
    return clash.where("doc_id is null or doc_id <> 302").unionByName(spark.createDataFrame(rows, SCHEMA), allowMissingColumns=True)


def brute_alike(rows):
    """Ids that stay of (id, text) when rows alike in 0.8 of their five-word shingles are one group."""
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    stay = {}
    for (i, _), k in zip(rows, label):
        stay[k] = min([stay[k], i] if k in stay else [i], key=lambda x: (x is None, x or 0))
    return Counter(stay.values())


def test_pipeline_stages_match_brute_force(spark, clash, tmp_path):
    """Each stage on what the one before kept: columns stay, and rows, texts, copies and ids are those of the definition."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = pipeline_rows(clash, spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(700 + k, 1, 0) for k in range(30)] + [(950 + k, 0, 0) for k in range(4)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    pairs = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    step = lambda name: common.materialize(stages[name](spark, now, str(tmp_path)), "stage")

    kept = step("quality rules")
    sound = [p for p in pairs(now) if p[1] and (s := brute_statistics(p[1]))[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    judged = {(r["doc_id"], r["n_words"], r["word_chars"]): r["kept"] for r in quality.judge(common.materialize(quality.rule_statistics(now), "t"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert kept.columns == docs.columns
    assert Counter(pairs(kept)) == Counter(p for p in sound if judged[p[0], brute_statistics(p[1])[0], brute_statistics(p[1])[1]])
    assert {700 + k for k in range(30)} <= {i for i, _ in pairs(kept)} and not {950 + k for k in range(8)} & {i for i, _ in pairs(kept)}

    now, before = kept, pairs(kept)
    kept = step("near-duplicates")
    assert kept.columns == docs.columns and Counter(i for i, _ in pairs(kept)) == brute_alike(before)
    assert len(before) - kept.count() >= 8

    now, before = kept, kept.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).collect()
    kept = step("repeated spans")
    want = brute_spans([tuple(r)[:2] for r in before], {tuple(r)[:2]: r["key"] for r in before})
    words = lambda t: tuple(t.encode().lower().split())
    assert kept.columns == docs.columns
    assert Counter((i, words(t)) for i, t in pairs(kept)) == Counter((k[0], tuple(w)) for k, (w, n) in want.items() if w or not n)
    assert all(r["n_chars"] == len(r["text"]) for r in kept.where("doc_id between 901 and 904").collect())

    now, before = kept, kept
    kept = step("mixture")
    domain, weights = registry.mixture()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before, domain, weights).select("doc.doc_id", "copies").collect()}  # told by its own brute force
    assert kept.columns == docs.columns and Counter(pairs(kept)) == Counter({p: copies[p[0]] for p in pairs(before) if copies[p[0]]})

    now, before = kept, pairs(kept)
    pieces = step("packing").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    held = Counter()
    for p in pieces:
        held[p["doc_id"], p["doc_tokens"]] += p["length"]
    whole = Counter()
    for i, t in before:
        n = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
        whole[i, n] += n
    assert held == whole
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
