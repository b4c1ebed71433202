"""Output and aggregates over data that grow, records of mixed shape, and both kinds of lines of one pass."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators import incremental
from quillon.sources import records as files
from quillon.sources import media, variants
from quillon.streaming.snapshots import Snapshots, rewrite_every

IDS = [7, "seven", [1, "a"], {"k": {"z": None}}, 1.5, True, None]


def test_ids_of_any_kind_survive(spark, tmp_path):
    lines = [json.dumps({"n": k, "id": i, "metadata": {"deep": [i, {"x": i}]}}) for k, i in enumerate(IDS)] + [json.dumps({"n": 99}), "{broken", "", "12"]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    rows = variants.read_variants(spark, f"{tmp_path}/in.jsonl")
    assert [r["value"] for r in rows.where("record is null").collect()] == ["{broken"]
    good = rows.where("record is not null")
    variants.write_variants(good, f"{tmp_path}/out")
    back = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted(json.dumps(x, sort_keys=True) for x in back) == sorted(json.dumps(json.loads(x), sort_keys=True) for x in lines if x and x != "{broken")
    ident = variants.part(F.col("record"), "$.id")
    got = {r["n"]: (r["kind"], r["text"]) for r in good.select(F.try_variant_get("record", "$.n", "int").alias("n"), variants.kind(ident).alias("kind"), variants.as_text(ident).alias("text")).collect()}
    assert got == {0: ("number", "7"), 1: ("string", "seven"), 2: ("array", '[1,"a"]'), 3: ("object", '{"k":{"z":null}}'), 4: ("number", "1.5"), 5: ("boolean", "true"), 6: ("null", None), 99: (None, None), None: (None, None)}
    assert "OBJECT" in variants.shape(good.where("try_variant_get(record, '$.n', 'int') is not null")).first()["shape"]


def test_media_of_any_shape(spark):
    rows = [('{"video": "a"}', ["a"]), ('{"video": ["a", "b"]}', ["a", "b"]), ('{"video": null, "image": "i"}', ["i"]), ('{"image": ["i"]}', ["i"]), ("{}", []), ('{"video": []}', []), ('{"video": 3}', [])]
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(rows)], "k int, v string").withColumn("r", F.parse_json("v"))
    assert {r["k"]: r["m"] for r in df.select("k", variants.media(F.col("r"), "$.video", "$.image").alias("m")).collect()} == {k: m for k, (_, m) in enumerate(rows)}


def test_split_writes_both_kinds_from_one_scan(spark, tmp_path):
    passed = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            passed.add(len(pdf))
            yield pdf

    rows = spark.range(100).mapInPandas(seen, "id long").withColumn("problems", F.when(F.col("id") % 10 == 0, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")))
    stats = files.write_split(rows, f"{tmp_path}/s", f"{tmp_path}/p", stats={"n": F.count(F.lit(1)), "bad": F.count_if(F.size("problems") > 0)})
    assert stats == {"n": 100, "bad": 10} and passed.value == 100
    assert spark.read.schema("id long, problems array<string>").json(f"{tmp_path}/p").where("problems[0] = 'bad' and id % 10 = 0").count() == 10
    assert {json.loads(r["value"]).keys() == {"id"} for r in spark.read.text(f"{tmp_path}/s").collect()} == {True}
    with pytest.raises(FileExistsError):
        files.write_split(rows, f"{tmp_path}/s", f"{tmp_path}/p", mode="errorifexists")
    assert files.write_split(rows.where("id % 10 > 0"), f"{tmp_path}/s", f"{tmp_path}/p") == {} and spark.read.text(f"{tmp_path}/p").count() == 0
    with pytest.raises(Exception, match="killed"):
        files.write_split(rows.withColumn("x", F.raise_error(F.lit("killed"))), f"{tmp_path}/s", f"{tmp_path}/p")
    assert sorted(os.listdir(tmp_path)) == ["p", "s"] and spark.read.text(f"{tmp_path}/s").count() == 90


def test_bad_lines_are_set_aside_with_their_place(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{oops\n{"a": "x"}\n{"a": 2}\n')
    assert files.sift(spark, f"{tmp_path}/a.jsonl", "a long", f"{tmp_path}/good", f"{tmp_path}/bad") == {"lines": 4, "good": 2, "bad": 2}
    bad = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/bad").collect()]
    assert {(b["line"], b["value"]) for b in bad} == {(3, "{oops"), (4, '{"a": "x"}')} and all(b["source_file"].endswith("a.jsonl") for b in bad)


def test_rewriting_goes_on_after_a_crash(spark, tmp_path):
    items, done = spark.range(25).withColumnRenamed("id", "k"), []

    def step(df, fail=None):
        keys = sorted(r["k"] for r in df.collect())
        if fail is not None and len(done) == fail:
            raise RuntimeError("crash")
        done.append(keys)
        return df.withColumn("out", F.col("k") * 2)

    for fail in (2, 3):
        with pytest.raises(RuntimeError):
            rewrite_every(spark, items, lambda df, f=fail: step(df, f), f"{tmp_path}/o", "k", 10 - fail)
    assert [len(d) for d in done] == [8, 8, 7]
    store = Snapshots(spark, f"{tmp_path}/o")
    assert store.version() == 3 and store.read().count() == 23 and store.read(1).count() == 8
    out = rewrite_every(spark, items, step, f"{tmp_path}/o", "k", 10)
    assert {(r["k"], r["out"]) for r in out.collect()} == {(k, 2 * k) for k in range(25)} and Counter(k for d in done for k in d) == Counter(range(25))
    assert rewrite_every(spark, items, step, f"{tmp_path}/o", "k", 10).count() == 25 and len(done) == 4
    assert rewrite_every(spark, items.limit(0), lambda df: df, f"{tmp_path}/none", "k", 3).count() == 0


def test_a_version_is_there_whole_or_not_at_all(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/v")
    assert store.read() is None
    assert store.write(spark.range(3)) == 1
    with pytest.raises(RuntimeError, match="another"):
        store.write(spark.range(9), after=0)
    with pytest.raises(Exception, match="killed"):
        store.write(spark.range(9).select(F.raise_error(F.lit("killed")).cast("long").alias("id")))
    assert store.version() == 1 and store.read().count() == 3
    assert store.write(spark.range(5)) == 2
    store.prune()
    left = [n for n in os.listdir(f"{tmp_path}/v") if n.startswith("data-")]
    assert len(left) == 1 and store.read().count() == 5


def test_states_of_batches_combine(spark, tmp_path):
    rows = [("a", 1, 5, "x", 0), ("a", 2, 9, "y", 0), ("a", 3, 9, "x", 1), (None, 4, 1, "z", 1), ("a", 5, None, None, 2), ("b", 6, 2, "y", 2), ("b", 7, 2, "x", 2)]
    df = spark.createDataFrame(rows, "g string, k long, s long, v string, batch int")
    kept = incremental.Aggregates(f"{tmp_path}/a", ["g"], {"n": incremental.count_if(F.col("s") > 4), "sum": incremental.total(F.col("s")), "top": incremental.best(F.col("v"), F.col("s"), F.col("k"))}, {"seen": (F.col("v"), F.col("k"))})
    for b in range(3):
        kept.put(df.where(F.col("batch") == b).drop("batch"), b)
    want = {"a": (3, 23, "y", ["x", "y"]), None: (0, 1, "z", ["z"]), "b": (0, 4, "y", ["y", "x"])}
    assert {r["g"]: (r["n"], r["sum"], r["top"], r["seen"]) for r in kept.result(spark).collect()} == want
    kept.put(df.where("batch = 1").drop("batch").withColumn("s", F.lit(100).cast("long")), 1)
    assert {r["g"]: r["sum"] for r in kept.result(spark).collect()} == {"a": 114, None: 100, "b": 4}
    kept.put(df.where("batch = 1").drop("batch"), 1)
    assert {r["g"]: r["sum"] for r in kept.result(spark).collect()} == {"a": 23, None: 1, "b": 4}


def test_missing_files_are_told_for_each_record(spark, tmp_path):
    for name in ("a/x.mp4", "a/deep/y.mp4", "b/z.png", "b/with space.mp4"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    files = media.media_files(spark, [f"{tmp_path}/a", f"file://{tmp_path}/b"])
    assert {(r["path"], r["length"]) for r in files.collect()} == {(f"{tmp_path}/{n}", 5) for n in ("a/x.mp4", "a/deep/y.mp4", "b/z.png", "b/with space.mp4")}
    assert media.media_files(spark, str(tmp_path), "*.png").count() == 1
    assert {r["path"] for r in media.media_folders(files).collect()} == {f"{tmp_path}/a", f"{tmp_path}/a/deep", f"{tmp_path}/b"}
    rows = [(1, [f"{tmp_path}/a/x.mp4", f"{tmp_path}/a/no.mp4", f"{tmp_path}/a/no.mp4"]), (2, []), (3, None), (4, [None, f"{tmp_path}/b/z.png"]), (5, [f"{tmp_path}/b/1", f"{tmp_path}/a/2"])]
    out = media.with_missing(spark.createDataFrame(rows, "k long, paths array<string>"), "k", F.col("paths"), files)
    assert {r["k"]: r["missing"] for r in out.collect()} == {1: [f"{tmp_path}/a/no.mp4"], 2: [], 3: [], 4: [], 5: [f"{tmp_path}/a/2", f"{tmp_path}/b/1"]}
    plan = files._jdf.queryExecution().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan  # no content
