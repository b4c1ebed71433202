"""Annotation pipelines and the operators around them on hand-made rows: failures, gaps and edges that the queries don't show."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays, geometry, scan, text
from quillon.operators import annotate, joins, records, split
from quillon.sources import records as files

SAID = "<think>Ball: <t>1s-2s</t> The ball floats. <t>3s-4s</t> The cup falls.</think> <t>5s-6s</t>\n<answer>Yes</answer>"


def one(df):
    (row,) = df.collect()
    return row


def video(spark, value, fps=10.0, frames=100):
    return spark.createDataFrame([(1, value, "v", fps, frames)], "id long, value string, video string, fps double, frames int")


def boxes(known):
    return lambda: lambda asked: [known.get(frame) for _, frame, _ in asked]


def test_spans_need_a_box_at_both_ends(spark):
    known = {10: [1, 2, 3, 4], 20: [5, 6, 7, 8], 30: [9, 9, 9, 9]}
    row = one(annotate.annotate_spans(video(spark, SAID), "id", segmenter=boxes(known)))
    assert row["value"] == SAID.replace("<t>1s-2s</t>", "<t>1s</t><box>[1,2,3,4]</box> to <t>2s</t><box>[5,6,7,8]</box>")
    assert (row["annotated_spans"], row["skipped_spans"], row["changed"]) == (1, 1, True)
    row = one(annotate.annotate_spans(video(spark, SAID), "id", segmenter=boxes(known), partial=True))
    assert "<t>3s</t><box>[9,9,9,9]</box> to <t>4s</t> The cup" in row["value"] and row["value"].count("<t>5s-6s</t>") == 1 and row["annotated_spans"] == 2


@pytest.mark.parametrize("value,fps,frames,skipped", [(SAID, 10.0, 0, 2), (SAID, 0.0, 10, 2), (SAID.replace("Yes", "No"), 10.0, 10, 0), ("<answer>Yes</answer>", 10.0, 10, 0), (None, 10.0, 10, 0)])
def test_spans_left_alone(spark, value, fps, frames, skipped):
    row = one(annotate.annotate_spans(video(spark, value, fps, frames), "id", segmenter=boxes({})))
    assert (row["value"], row["annotated_spans"], row["skipped_spans"], row["changed"]) == (value, 0, skipped, False)


def test_a_failing_request_is_that_request_alone(spark):
    def segmenter():
        def answer(asked):
            if any(frame == 20 for _, frame, _ in asked):
                raise ValueError("dark")
            return [[frame, 0, 1, 1] for _, frame, _ in asked]

        return answer

    asked = spark.createDataFrame([("v", f, "x") for f in (10, 20, 30, 30)], "video string, frame int, prompt string").coalesce(1)
    assert {r["frame"]: r["box"] for r in annotate.segment(asked, segmenter).collect()} == {10: [10, 0, 1, 1], 20: None, 30: [30, 0, 1, 1]}


def test_nouns_are_written_into_the_response(spark):
    rows = video(spark, SAID.replace("Yes", "Video Quality: No.")).withColumns({"thinking": F.lit("The ball floats. <t>3s-4s</t> The cup falls."), "nouns": F.array(F.lit("cup"), F.lit("ball"))})
    row = one(annotate.annotate_nouns(rows, "id", segmenter=boxes({30: [1, 2, 3, 4]})))
    assert "The cup at <t>3.0s</t><box>[1, 2, 3, 4]</box> falls." in row["value"] and "<t>1.0s</t> to <t>2.0s</t>" in row["value"] and "ball at" not in row["value"]


def test_noun_without_a_range_before_it_has_no_mention():
    assert scan.noun_mentions("<t>0s-1s</t> a cup, a cup", ["cup"] * 5 + ["dog", ""]) == [
        {"noun": "cup", "start_sec": 0.0, "end_sec": 1.0, "begin": at, "end": at + 3} for at in (15, 22)
    ]
    assert scan.noun_mentions("cup <t>0s-1s</t> cup", ["cup"]) == [] == scan.noun_mentions("cup", ["cup"])


def test_boxed_nouns_are_passed_over():
    done = "cup at <t>1.0s</t> <box>[1]</box> and cup"
    assert scan.place_boxes(done, [{"noun": "cup", "start_sec": 2.0, "box": [5]}]) == "cup at <t>1.0s</t> <box>[1]</box> and cup at <t>2.0s</t><box>[5]</box>"
    assert scan.place_boxes("no such", [{"noun": "cup", "start_sec": 2.0, "box": [5]}, {"noun": "no", "start_sec": 1.0, "box": None}]) == "no such"


def test_positions_and_zip(spark):
    a = spark.createDataFrame([(k, f"a{k}") for k in (5, 1, 9, 3)], "k int, a string").repartition(3)
    b = spark.createDataFrame([(k,) for k in (40, 10, 30)], "b int")
    assert {(r["a"], r["_idx"]) for r in split.positions(a, ["k"]).collect()} == {("a1", 0), ("a3", 1), ("a5", 2), ("a9", 3)}
    assert {(r["a"], r["b"]) for r in joins.zip_in_order(a, b, ["k"], ["b"]).collect()} == {("a1", 10), ("a3", 30), ("a5", 40)}
    assert split.positions(a.where("k < 0"), ["k"]).count() == 0


def test_files_by_extension(spark, tmp_path):
    rows = spark.createDataFrame([(3, "c"), (1, None), (2, "b")], "k long, t string")
    for name in ("r.json", "r.jsonl"):
        files.write_by_extension(rows.orderBy("k"), f"{tmp_path}/{name}")
    assert [tuple(r) for r in files.read_array(spark, f"{tmp_path}/r.json", "k long, t string").orderBy("_idx").collect()] == [(0, 1, None), (1, 2, "b"), (2, 3, "c")]
    assert files.read_jsonl(spark, f"{tmp_path}/r.jsonl", "k long, t string").count() == 3
    files.write_by_extension(rows.where("k > 9"), f"{tmp_path}/none.json")
    assert files.read_array(spark, f"{tmp_path}/none.json", "k long").count() == 0
    with pytest.raises(ValueError):
        files.write_by_extension(rows, f"{tmp_path}/r.csv")
    with pytest.raises(ValueError):
        files.read_array(spark, f"{tmp_path}/r.jsonl", "k long")


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {k} {'x' * (k % 50)}\n" if k % 7 else "\n" for k in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = {(r["line"], r["value"].split()[1]) for r in files.numbered_lines(spark, str(path)).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(k, str(k)) for k in range(1, 3001) if k % 7}


def test_what_raises(spark):
    row = spark.createDataFrame([("0-9", [("gpt", "x")])], "i string, c array<struct<from:string,value:string>>")
    with pytest.raises(Exception, match="index outside 0..4"):
        row.select(arrays.index_list(F.col("i"), F.lit(5))).collect()
    with pytest.raises(Exception, match="no turn of human"):
        row.select(records.required_value(F.col("c"))).collect()


def test_rope_of_a_grid_below_a_cell():
    assert arrays.rope_positions([1, 9, 2], [(1, 1, 1)], 8, 9, 10) == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]


@pytest.mark.parametrize(
    "fixed,limit,source,duration,fps,expect",
    [(8, 4, 100, 10.0, 2.0, 8), (None, 4, 100, 10.0, 2.0, 4), (None, None, 100, 10.0, 2.5, 25), (None, None, 10, 10.0, 2.5, 10), (None, None, 100, None, 2.5, 100), (200, None, None, None, None, 200), (None, None, None, None, None, None), (-1, 0, 7, 0.1, 1.0, 1)],
)
def test_frame_cascade(spark, fixed, limit, source, duration, fps, expect):
    rows = spark.createDataFrame([(fixed, limit, source, duration, fps)], "a int, b int, s int, d double, f double")
    assert one(rows.select(geometry.sampled_frames([F.col("a")], F.col("b"), F.col("s"), F.col("d"), F.col("f")).alias("n")))["n"] == expect


def test_sentences_once_and_in_order(spark):
    rows = spark.createDataFrame([(["B one.", " a two! ", "b ONE", "...", "A two", "c"],), ([],)], "s array<string>")
    assert [r["d"] for r in rows.select(text.distinct_by_key(F.col("s")).alias("d")).collect()] == [["B one.", "a two!", "c"], []]
