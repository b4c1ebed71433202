"""JSON arrays by byte ranges: nothing lost or doubled wherever a border falls; an array in parts is all or nothing."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillon.sources import arrays
from quillon.sources.records import read_array, read_packed, write_by_extension


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes, so that borders fall everywhere."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("97", "1")):
        spark.conf.set(k, v)
    yield
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def awkward(rng, depth=0):
    """A value with braces, brackets, commas, quotes and backslashes in its strings."""
    kind = rng.randint(0, 5 if depth < 3 else 3)
    if kind == 4:
        return [awkward(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if kind == 5:
        return {rng.choice(['a', '}"', "\\", "k,"]) + str(k): awkward(rng, depth + 1) for k in range(rng.randint(0, 3))}
    if kind == 3:
        return rng.choice([None, True, 12, -1.5, 0])
    return "".join(rng.choice(['}', '{', '[', ']', ',', '"', "\\", "é", "\n", "word ", "\\}"]) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("indent", [None, 1])
def test_elements_survive_any_border(spark, tmp_path, small_ranges, indent):
    rng = random.Random(4)
    want = [awkward(rng) for _ in range(300)] + ["}" * 700, {"long": "x}" * 900}, [], {}]
    path = tmp_path / "a.json"
    path.write_bytes(b"\xef\xbb\xbf \n" + json.dumps(want, indent=indent, ensure_ascii=False).encode() + b" \n")
    fragments = arrays._fragments(spark, str(path))
    assert fragments.select("block").distinct().count() > 100 and fragments.rdd.getNumPartitions() > 100
    rows = arrays.read_elements(spark, str(path)).collect()
    assert len(rows) == len(want) and [json.loads(r["value"]) for r in sorted(rows, key=lambda r: r["number"])] == want


def test_borders_one_by_one(spark, tmp_path):
    """Every width of ranges over one text, without Spark: sums composed and elements cut as the source does it."""
    data = json.dumps([{"a": '}"\\'}, "}", [{"b": "],"}], 3, {"c": {"d": "{"}}, '\\"}']).encode()
    pieces = data.split(b"}")
    fragments = [pieces[0], *(b"}" + p for p in pieces[1:])]
    for width in range(1, len(fragments) + 1):
        ranges = [fragments[k : k + width] for k in range(0, len(fragments), width)]
        state, parts = (False, 0, 0), {}
        for r in ranges:
            for number, _, _, _, text in arrays._cut(iter(r), *state):
                parts[number] = parts.get(number, b"") + text
            case = arrays.Sum(state[0])
            for f in r:
                case.add(f)
            state = case.inside, state[1] + case.depth, state[2] + case.begun[1 - state[1]]
        assert state[:2] == (False, 0) and [json.loads(parts[k]) for k in sorted(parts)] == json.loads(data)


@pytest.mark.parametrize("text, says", [('[{"a": 1}, {"a"', "doesn't end"), ('[{"a": 1}', "JSON array"), ('[1]}', "JSON array"), ('[{"a": 1} ', "doesn't end"), ('[{"a": "x}', "JSON array"), ('[{"a": "x} ', "doesn't end"), ('[1]]', "closed"), ("[1, , 2]", "missing"), ("[1] 2", "JSON array"), ('[1,{"a":1},\n]', "missing"), ('{"a": 1}', "JSON array")])
def test_what_is_no_array_raises(spark, tmp_path, small_ranges, text, says):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match=says):
        arrays.read_elements(spark, f"{tmp_path}/bad.json").collect()


def test_arrays_of_a_folder_follow_one_another(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, rows in (("b", [3]), ("a", [{"x": 1}, 2]), ("c", []), ("d", [4, 5])):
        (tmp_path / "d" / f"{name}.json").write_text(json.dumps(rows))
    rows = sorted(arrays.read_elements(spark, f"{tmp_path}/d").collect(), key=lambda r: r["number"])
    assert [json.loads(r["value"]) for r in rows] == [{"x": 1}, 2, 3, 4, 5]


def whole(path):
    return b"".join(open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if n.startswith("part-"))


def test_parts_are_one_valid_array(spark, tmp_path, small_ranges):
    rows = spark.range(0, 500, 1, 9).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit('}],"'), F.col("id"))).alias("t"))
    for name, df, want in (("all", rows, list(range(500))), ("gaps", rows.where("id between 120 and 130 or id > 480"), [*range(120, 131), *range(481, 500)]), ("none", rows.where("id < 0"), [])):
        path = f"{tmp_path}/{name}.json"
        write_by_extension(df, path)
        assert [r["id"] for r in json.loads(whole(path))] == want
        back = read_array(spark, path, "id long, t string").orderBy("_idx").collect()
        assert [r["id"] for r in back] == want and all(r["t"] == (f'}}],"{r["id"]}' if r["id"] % 7 else None) for r in back)
    assert len([n for n in os.listdir(f"{tmp_path}/all.json") if n.endswith(".txt")]) == 9
    with pytest.raises(FileExistsError):
        write_by_extension(rows, f"{tmp_path}/all.json")
    write_by_extension(rows.limit(1), f"{tmp_path}/all.json", "overwrite")
    assert len(json.loads(whole(f"{tmp_path}/all.json"))) == 1
    write_by_extension(rows, f"{tmp_path}/all.json", "ignore")
    assert len(json.loads(whole(f"{tmp_path}/all.json"))) == 1


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        write_by_extension(rows, f"{tmp_path}/r.json")
    assert os.listdir(tmp_path) == []
    write_by_extension(spark.range(3), f"{tmp_path}/r.json")
    with pytest.raises(Exception, match="killed"):
        write_by_extension(rows, f"{tmp_path}/r.json", "overwrite")
    assert len(json.loads(whole(f"{tmp_path}/r.json"))) == 3 and os.listdir(tmp_path) == ["r.json"]


def test_packs_by_ranges(spark, tmp_path, small_ranges):
    items = [[{"id": f"{k}-{j}", "conversations": [{"from": "human", "value": "a]},["}]} for j in range(k % 4 + 1)] for k in range(60)]
    items[7] = {"id": "single", "conversations": []}
    (tmp_path / "p.json").write_text(json.dumps(items, indent=2))
    packs = {r["pack"]: [m["id"] for m in r["members"]] for r in read_packed(spark, f"{tmp_path}/p.json").collect()}
    assert packs == {k: [m["id"] for m in (p if isinstance(p, list) else [p])] for k, p in enumerate(items)}
    flat = read_packed(spark, f"{tmp_path}/p.json", flatten=True)
    assert flat.count() == sum(len(p) if isinstance(p, list) else 1 for p in items)
