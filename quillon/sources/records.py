"""JSON and JSONL annotation files, the dataset catalog, and sinks.

Order in a file has meaning, so every reader can number its rows. Numbers come from ``_metadata`` offsets of
text lines, not from a global sort.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.records import media_list
from quillon.operators.split import exact_sample, sampling_rate
from quillon.sources.arrays import read_elements, write_array

TURNS = "array<struct<from:string,value:string>>"
#: Fields as text where files differ in shape; ``annotations`` settles them.
RECORD = f"images string, image string, videos string, video string, conversations {TURNS}, metadata string, id string, key string, num_tokens int, data_path string"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, line, value) of every line, blank ones included in the count but left out.

    A block of a file is read in order by one task, so a line's number is its place in the block after the lines of the
    blocks before: lines are counted by block, and only the blocks, one row each, are put in order.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    blocks = raw.groupBy("source_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    line = (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("int").alias("line")
    return raw.where(F.col("value").rlike(r"\S")).join(blocks, ["source_file", "_block"]).select("source_file", line, "value")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType = RECORD, mode: str = "strict") -> DataFrame:
    """JSONL by mode: 'strict' fails on a bad line, 'tolerant' leaves bad lines out; a missing path is empty if tolerant."""
    reader = spark.read.schema(schema)
    if mode == "strict":
        return reader.json(path, mode="FAILFAST")
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
    return reader.json(path, mode="DROPMALFORMED")


def read_numbered_jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records with ``source_file`` and ``line``, blank lines skipped."""
    return numbered_lines(spark, path).withColumn("r", F.from_json("value", schema)).select("source_file", "line", "r.*")


def read_array(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """JSON arrays, ``_idx`` the order of their elements; anything else raises. Ranges of a file are read by many tasks."""
    record = F.from_json("value", schema, {"mode": "FAILFAST"})
    return read_elements(spark, path).select(F.col("number").alias("_idx"), record.alias("r")).select("_idx", "r.*")


def read_inferred(spark: SparkSession, path: str, sampling: float = 1.0) -> DataFrame:
    """JSON lines of any shape: the schema is that of the records themselves, or of a share of them."""
    return spark.read.json(path, samplingRatio=sampling)


def read_packed(spark: SparkSession, path: str, flatten: bool = False) -> DataFrame:
    """A JSON array of packs (arrays of records), one row a pack, or a record with ``flatten``; single records are packs of one.

    Packs and records may stand side by side. A pack is one row; its file is read by many tasks.
    """
    kind = _struct(RECORD)
    members = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{kind}>")).otherwise(F.array(F.from_json("value", kind)))
    packs = read_elements(spark, path).select(F.col("number").alias("pack"), F.expr("ltrim('\\r\\n\\t ', value)").alias("value")).select("pack", members.alias("members"))
    return packs.select("pack", F.posexplode("members").alias("pos", "r")).select("pack", "pos", "r.*") if flatten else packs


def _fields(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def _struct(schema: str) -> str:
    return f"struct<{','.join(':'.join(f.strip().split(' ', 1)) for f in _fields(schema))}>"


def read_any(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path) if path.endswith(".jsonl") else read_array(spark, path)


def read_categories(spark: SparkSession, root: str, schema: str, removed: bool = False, parts: bool = False) -> DataFrame:
    """Files of a name in every sub-folder: records with category, source_file, line and ``_seq``, their place in the scan.

    ``parts``: such a name may be a folder of part files, as a distributed writer leaves it.
    """
    names = ["sampled.jsonl", *(["removed_scene_jumpcut.jsonl"] if removed else [])]
    lines = numbered_lines(spark, [f"{root}/*/{n}" for n in names])
    rows = lines.withColumn("r", F.from_json("value", schema)).withColumn("category", F.element_at(F.split("source_file", "/"), -3 if parts else -2))
    late = (~F.contains("source_file", F.lit("/sampled.jsonl"))).cast("int")
    place = F.concat_ws("/", F.col("category"), late.cast("string"), F.lpad(F.col("line").cast("string"), 12, "0"))
    return rows.select("category", "source_file", "line", place.alias("_seq"), "r.*")


def annotations(raw: DataFrame) -> DataFrame:
    """Scanned records with images and videos as arrays, whatever their field and shape was."""
    return raw.withColumns({"images": media_list(F.col("images"), F.col("image")), "videos": media_list(F.col("videos"), F.col("video"))}).drop("image", "video")


@dataclass
class Catalog:
    """Names of datasets: where the annotations are, where the media are."""

    entries: dict[str, dict[str, str]] = field(default_factory=dict)
    reader: Callable[[SparkSession, str], DataFrame] = read_any

    def register(self, name: str, annotation_path: str, data_path: str = "") -> None:
        self.entries[name] = {"annotation_path": annotation_path, "data_path": data_path}

    def resolve(self, names: str) -> list[tuple[dict[str, str], float]]:
        """'a%50,b' to entries and rates; an unknown name raises."""
        out = []
        for part in names.split(","):
            name, rate = sampling_rate(part.strip())
            if name not in self.entries:
                raise ValueError(f"no dataset named {name}")
            out.append((self.entries[name], rate))
        return out

    def read(self, spark: SparkSession, names: str, seed: int = 42) -> DataFrame:
        """All sources, each sampled at its rate, its media root on every record."""
        parts = []
        for entry, rate in self.resolve(names):
            rows = annotations(self.reader(spark, entry["annotation_path"]))
            rows = rows if "_idx" in rows.columns else rows.withColumn("_idx", F.monotonically_increasing_id())
            parts.append(exact_sample(rows, rate, "_idx", seed).withColumn("data_path", F.lit(entry["data_path"])))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# -- sinks -----------------------------------------------------------------------------------


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, committed as a whole by Spark's output committer; nothing of a failed write is seen."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_by_extension(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``.jsonl``: a line a record; ``.json``: one array, in parts that follow one another; anything else raises."""
    if path.endswith(".jsonl"):
        write_records(df, path, mode)
    elif path.endswith(".json"):
        write_array(df, path, mode)
    else:
        raise ValueError(f"neither .json nor .jsonl: {path}")


def append_records(df: DataFrame, path: str) -> None:
    write_records(df, path, "append")


def write_split(df: DataFrame, valid_path: str, problem_path: str, problems: str = "problems", mode: str = "overwrite", stats: dict[str, Column] | None = None) -> dict:
    """Sound records to one place, those with problems, and what they are, to another; returns ``stats``, aggregates over all rows.

    One job writes both and one scan feeds it: the two kinds are folders of one write, renamed when it has
    ended, and the aggregates are observed as the rows pass.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(valid_path).getFileSystem(conf)
    taken = [p for p in (valid_path, problem_path) if fs.exists(at(p))]
    if mode != "overwrite" and taken:
        raise FileExistsError(taken[0])
    seen = Observation()
    if stats:
        df = df.observe(seen, *[c.alias(k) for k, c in stats.items()])
    line = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    sound = F.size(problems) == 0
    lines = df.select(F.when(sound, line([c for c in df.columns if c != problems])).otherwise(line(df.columns)).alias("value"), F.when(sound, "sound").otherwise("problem").alias("kind"))
    staging = at(valid_path).getParent().toString() + f"/_split-{uuid.uuid4().hex}"
    try:
        lines.write.partitionBy("kind").text(staging)
        for name, path in (("sound", valid_path), ("problem", problem_path)):
            fs.delete(at(path), True)
            fs.mkdirs(at(path).getParent())
            if fs.exists(at(f"{staging}/kind={name}")):
                fs.rename(at(f"{staging}/kind={name}"), at(path))
            else:
                fs.mkdirs(at(path))
    finally:
        fs.delete(at(staging), True)
    return seen.get if stats else {}


def sift(spark: SparkSession, path: str, schema: str, good_path: str, bad_path: str) -> dict:
    """JSON lines into those that parse, and the others with file and line; returns how many there were of each."""
    broken = "_corrupt"
    parsed = numbered_lines(spark, path).withColumn("r", F.from_json("value", f"{schema}, {broken} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}))
    bad = F.col(f"r.{broken}").isNotNull()
    rows = parsed.select("source_file", "line", "value", F.when(bad, F.array(F.lit("no JSON record"))).otherwise(F.array().cast("array<string>")).alias("problems"))
    counts = {"lines": F.count(F.lit(1)), "good": F.count_if(F.size("problems") == 0), "bad": F.count_if(F.size("problems") > 0)}
    return write_split(rows, good_path, bad_path, stats=counts)


def write_categories(df: DataFrame, root: str, category: str, name: str) -> None:
    """Records into ``root``/category/name, by one job; the folders are renamed into place when it has ended."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs, staging = at(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), f"{root}/_categories-{uuid.uuid4().hex}"
    df.write.partitionBy(category, name).option("ignoreNullFields", "false").json(staging)
    plain = lambda folder: jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.getName().split("=", 1)[1])
    below = lambda path: [x.getPath() for x in fs.listStatus(path) if x.isDirectory()]
    for outer in below(at(staging)):  # a folder a category
        fs.mkdirs(at(f"{root}/{plain(outer)}"))
        for inner in below(outer):
            if not fs.rename(inner, at(f"{root}/{plain(outer)}/{plain(inner)}")):
                raise OSError(f"could not rename {inner}")
    fs.delete(at(staging), True)


def write_metrics(metrics: DataFrame, schema: str, path: str, mode: str = "overwrite") -> None:
    """Per dimension and overall as one JSON line; a metric table has a row a dimension."""
    row = F.struct(*[c for c in metrics.columns if c != "dim"])
    one = metrics.agg(
        F.lit(schema).alias("metric_schema"), F.map_from_entries(F.collect_list(F.when(F.col("dim") != "overall", F.struct("dim", row)))).alias("per_dim"),
        F.first(F.when(F.col("dim") == "overall", row), ignorenulls=True).alias("overall"),
    )
    write_records(one.coalesce(1), path, mode)
