"""Operators over records, splits, merges, packing, sources, sinks and restarts."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import infer, joins, metrics, packing, records, split
from quillon.sources.records import Catalog, annotations, append_records, read_array, read_categories, read_jsonl, read_numbered_jsonl, read_packed, write_metrics, write_records, write_split
from quillon.streaming.resume import cached, process_stream, results, resume


def test_confusion(spark):
    said = [("yes", "yes"), ("no", "yes"), ("yes", "no"), ("no", "no"), ("fail", "yes"), ("yes", "?")]
    rows = spark.createDataFrame([(f"<answer>{p}</answer>", f"<answer>{g}</answer>") for p, g in said], "answer string, ground_truth string")
    r = {x["dim"]: x for x in metrics.confusion(rows, "single_issue").collect()}["overall"]
    assert [r[k] for k in ("total", "gt_yes", "gt_no", "tp", "tn", "fp", "fn", "fail_pred", "correct")] == [5, 3, 2, 1, 1, 1, 1, 1, 2]
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (0.4, 0.5, 0.5, 0.5)
    zero = metrics.confusion(rows.where("false"), "merged").collect()
    assert all(x["total"] == 0 and x["f1"] == 0.0 for x in zero)


@pytest.mark.parametrize("sizes,total,expect", [({"Yes": 7, "No": 3}, 5, {"Yes": 4, "No": 1}), ({"A": 1, "B": 1, "C": 1}, 2, {"A": 1, "B": 1, "C": 0})])
def test_apportion(spark, sizes, total, expect):
    groups = spark.createDataFrame([(k, n, i) for i, (k, n) in enumerate(sizes.items())], "label string, n long, first long")
    assert {r["label"]: r["take"] for r in split.apportion(groups, "label", "n", "first", total).collect()} == expect


@pytest.mark.parametrize("name,n", [("d%20", 1), ("d%0", 0), ("d%200", 9), ("d", 9)])
def test_exact_sample(spark, name, n):
    rows = spark.range(9)
    assert split.exact_sample(rows, split.sampling_rate(name)[1], "id").count() == n


def test_split_sizes(spark):
    rows = spark.range(1000).withColumn("l", F.when(F.col("id") % 7 == 0, "a").otherwise("b"))
    out = split.stratified_split(rows, F.col("l"), "id", 100)
    assert out.where("split = 'test'").count() == 100 and out.count() == 1000
    again = split.stratified_split(rows.repartition(5), F.col("l"), "id", 100)
    assert {r["id"] for r in out.where("split = 'test'").collect()} == {r["id"] for r in again.where("split = 'test'").collect()}


def test_merges(spark):
    base = spark.createDataFrame([(3, "old"), (4, "old")], "i int, v string")
    shards = spark.createDataFrame([(3, "r0", "rank0", 1), (3, None, "rank1", 1)], "i int, v string, file string, line int")
    out = {r["i"]: r["v"] for r in joins.upsert(base, shards, "i", ["file", "line"], ["v"]).collect()}
    assert out == {3: None, 4: "old"}
    assert joins.first_write(shards, "i", ["file", "line"]).first()["v"] == "r0"
    done = spark.createDataFrame([(3,), (3,), (None,)], "i int")
    assert [r["i"] for r in joins.pending(base, done, "i").collect()] == [4]


def test_best_keeps_the_first_of_ties(spark):
    rows = spark.createDataFrame([(1, 0.5, 2), (1, 0.5, 1), (2, 0.1, 3)], "g int, s double, k int")
    assert [(r["g"], r["k"]) for r in split.best(rows, ["g"], "s", "k", 0.2).collect()] == [(1, 1)]


def test_validator(spark):
    turn = "array<struct<from:string,value:string>>"
    rows = spark.createDataFrame([([("human", "<image><image>"), ("gpt", "<video>")], ["a"], [])], f"c {turn}, i array<string>, v array<string>")
    got = rows.select(records.problems(F.col("c"), F.col("i"), F.col("v")).alias("p")).first()["p"]
    assert [(p["type"], p["media_type"], p["expected"], p["actual"]) for p in got] == [("token_mismatch", "image", 1, 2), ("gpt_media_token", None, None, None)]


def test_drop_nullish(spark):
    rows = spark.createDataFrame([(1, [("gpt", "Nullify")]), (2, [("gpt", "ok")]), (3, [])], "id int, conversations array<struct<from:string,value:string>>")
    assert [r["id"] for r in records.drop_nullish(rows).orderBy("id").collect()] == [2, 3]


def test_packs(spark):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate([4000, 90, 50, 5000, 46, 6])], "i long, n long")
    out = packing.pack_blocks(rows, "i", "n", capacity=4096, block=4).collect()
    assert sorted(r["i"] for r in out) == list(range(6)) and {r["block"] for r in out} == {0, 1}
    load = {}
    for r in out:
        load.setdefault((r["block"], r["pack"]), []).append(r["n"])
    assert all(sum(x) <= 4096 or len(x) == 1 for x in load.values())


def test_time_instruction(spark):
    got = spark.range(1).select(records.time_instruction(F.lit(1.0), F.lit(8), F.lit(7.25)).alias("x"), records.time_instruction(F.lit(None).cast("double"), F.lit(8), F.lit(7.0)).alias("y")).first()
    assert got["x"] == "This video is uniformly sampled at 1.00 fps, contains 8 frames from 0 seconds to 7.2 seconds." and got["y"] == ""


# -- sources ----------------------------------------------------------------------------------


def turns(x):
    return [{"from": "human", "value": f"<video>{x}"}, {"from": "gpt", "value": "é"}]


def test_sources(spark, tmp_path):
    items = [{"videos": "v0", "conversations": turns(0)}, {"images": ["i1", "i2"], "conversations": turns(1), "metadata": {"a": 1}}, {"video": ["v2"], "conversations": turns(2)}]
    (tmp_path / "a.json").write_text(json.dumps(items, indent=1))
    (tmp_path / "b.jsonl").write_text("\n\n".join(map(json.dumps, items)) + "\n")
    (tmp_path / "bad.jsonl").write_text(json.dumps(items[0]) + "\n{oops\n")
    (tmp_path / "packed.json").write_text(json.dumps([items[:2], items[2]]))
    (tmp_path / "object.json").write_text("{}")
    rows = annotations(read_array(spark, f"{tmp_path}/a.json")).orderBy("_idx").collect()
    assert [(r["images"], r["videos"]) for r in rows] == [([], ["v0"]), (["i1", "i2"], []), ([], ["v2"])] and rows[0]["conversations"][1]["value"] == "é"
    numbered = read_numbered_jsonl(spark, f"{tmp_path}/b.jsonl").orderBy("line").collect()
    assert [r["line"] for r in numbered] == [1, 3, 5]
    assert read_jsonl(spark, f"{tmp_path}/bad.jsonl", mode="tolerant").where("conversations is not null").count() == 1
    assert read_jsonl(spark, f"{tmp_path}/none.jsonl", mode="tolerant").count() == 0
    with pytest.raises(Exception):  # noqa: B017
        read_jsonl(spark, f"{tmp_path}/bad.jsonl").collect()
    with pytest.raises(Exception):  # noqa: B017
        read_array(spark, f"{tmp_path}/object.json").collect()
    packs = read_packed(spark, f"{tmp_path}/packed.json").orderBy("pack").collect()
    assert [len(p["members"]) for p in packs] == [2, 1]
    assert read_packed(spark, f"{tmp_path}/packed.json", flatten=True).count() == 3
    catalog = Catalog()
    catalog.register("a", f"{tmp_path}/a.json", "/media")
    catalog.register("b", f"{tmp_path}/b.jsonl", "/other")
    got = catalog.read(spark, "a%67,b").groupBy("data_path").count().collect()
    assert {r["data_path"]: r["count"] for r in got} == {"/media": 2, "/other": 3}
    with pytest.raises(ValueError):
        catalog.resolve("c")


def test_categories(spark, tmp_path):
    for d in ("y", "x"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "sampled.jsonl").write_text("\n".join(json.dumps({"video_path": f"{d}{k}"}) for k in range(3)))
    (tmp_path / "x" / "removed_scene_jumpcut.jsonl").write_text(json.dumps({"video_path": "gone"}))
    rows = read_categories(spark, str(tmp_path), "video_path string", removed=True).orderBy("_seq").collect()
    assert [r["video_path"] for r in rows] == ["x0", "x1", "x2", "gone", "y0", "y1", "y2"] and rows[0]["category"] == "x"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["p"]), (2, [])], "id int, problems array<string>")
    write_split(rows, f"{tmp_path}/ok", f"{tmp_path}/bad")
    assert spark.read.json(f"{tmp_path}/ok").count() == 1 and spark.read.json(f"{tmp_path}/bad").first()["problems"] == ["p"]
    write_records(rows, f"{tmp_path}/r")
    append_records(rows, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 4
    found = metrics.confusion(spark.createDataFrame([("yes", "yes")], "answer string, ground_truth string"), "single_issue")
    write_metrics(found, "single_issue", f"{tmp_path}/m")
    saved = spark.read.json(f"{tmp_path}/m").first()
    assert saved["metric_schema"] == "single_issue" and saved["overall"]["tp"] == 1 and saved["per_dim"]["Answer"]["fn"] == 0


# -- inference and restarts ---------------------------------------------------------------------


def flaky():
    """A model factory that travels by value: workers can't import this file."""

    def make():
        def ask(requests):
            if any("bad" in r for r in requests):
                raise RuntimeError("no")
            return [r.upper() for r in requests]

        return ask

    return make


def test_generate_keeps_rows_and_errors(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id int, t string")
    out = {r["id"]: r for r in infer.generate(rows, "t", "out", flaky(), batch=2).collect()}
    assert out[1]["out"] == "A" and out[3]["out"] == "C" and out[2]["out"] is None and "no" in out[2]["error"]
    some = infer.generate_where(rows, F.col("id") == 1, "t", "out", F.lit("-"), flaky()).collect()
    assert {r["id"]: r["out"] for r in some} == {1: "A", 2: "-", 3: "-"}


def test_stream_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([(k, "bad" if k == 2 else "x") for k in range(5)], "id int, t string")
    rows.write.parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    assert resume(spark, rows, out, "id").count() == 5
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        process_stream(stream, lambda df: infer.generate(df, "t", "out", flaky(), batch=1), out, f"{tmp_path}/check").awaitTermination()
    assert results(spark, out, "id").count() == 4
    assert [r["id"] for r in resume(spark, rows, out, "id").collect()] == [2]
    made = []
    for _ in range(2):
        cached(spark, f"{tmp_path}/cache", lambda: made.append(1) or rows)
    assert made == [1]
