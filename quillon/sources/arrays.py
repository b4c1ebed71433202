"""JSON arrays of any length, read and written by many tasks.

Reading. Spark's own text reader cuts a file into byte ranges, and with ``}`` as the line separator into
fragments, whatever the file's layout and wherever it lies. What a range means depends on what precedes it: whether it
starts inside a string, and how deep. A first pass sums up each range for both cases: the case it ends in,
by how much it deepens, and the elements it begins by relative depth. Those sums, one row a range, are composed in order
of files and offsets; then every range knows its state at the start, and the second pass cuts it into elements.
Only elements that reach over the border of a range, two a range at most, are put together by a shuffle.

Files are taken in order of their paths as one text that holds arrays one after another, so a folder of arrays is
read as well as one array in parts.

Writing. Every task writes the elements of its partition, parted by commas, with Spark's committer into a folder beside the
target. When all have done so the driver adds brackets and commas between the parts, files of a byte or two, and renames
the folder: until then there is nothing at the target, and then the files in order of their names are one valid array.

Defined cases: an empty array has no elements; blanks and a byte order mark are skipped; nulls and numbers are elements
as well; text outside an array, an element that is missing between commas, and an array that doesn't end raise.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A string, a character of structure, or the quote of a string that goes on behind the fragment.
TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|[\[\]{},"]', re.S)
STRING_END = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
STRING = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
STRUCTURE = b'[]{},"'
OTHERS = bytes(b for b in range(256) if b not in STRUCTURE)
BLANK = re.compile(r"\A[ \t\r\n]*\Z")
BLANK_BYTES = b" \t\r\n"
#: Length of a byte order mark, which the text reader skips.
BOM_BYTES = 3


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the text between closing braces, in order within a byte range of a file."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _ranges(batches) -> Iterator[tuple[int, int, Iterator[bytes]]]:
    """(file, block, fragments) of each byte range; a fragment has the brace before it, but for a file's first."""
    rows = (r for b in batches for r in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value")))
    ahead = next(rows, None)
    while ahead is not None:
        key, first = ahead[:2], ahead
        waiting = True

        def fragments():
            nonlocal ahead, waiting
            waiting = False
            yield (b"" if key[1] == 0 else b"}") + first[2].as_py()
            for ahead in rows:
                if ahead[:2] != key:
                    return
                yield b"}" + ahead[2].as_py()
            ahead = None

        found = fragments()
        yield *key, found
        for _ in found:
            pass


class Sum:
    """What a byte range does to one case of its start: inside a string or not."""

    def __init__(self, inside: bool):
        self.inside, self.depth, self.begun, self.objects = inside, 0, Counter(), set()

    def add(self, fragment: bytes) -> None:
        if self.inside:
            end = STRING_END.match(fragment)
            if not end:
                return
            fragment, self.inside = fragment[end.end() :], False
        for c in STRING.sub(b"", fragment).translate(None, OTHERS):
            if c == 0x2C:  # ,
                self.begun[self.depth] += 1
            elif c in b"[{":
                self.depth += 1
                if c == 0x5B:
                    self.begun[self.depth] += 1
                else:
                    self.objects.add(self.depth)
            elif c in b"]}":
                self.depth -= 1
            else:  # a quote without its second
                self.inside = True
                return


def _sums(batches):
    for file, block, fragments in _ranges(batches):
        cases = [Sum(False), Sum(True)] if block else [Sum(False)]
        size = 0
        for fragment in fragments:
            size += len(fragment)
            for case in cases:
                case.add(fragment)
        begun = [[{"depth": d, "n": n} for d, n in sorted(c.begun.items())] for c in cases]
        yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "size": [size], "inside": [[c.inside for c in cases]], "depth": [[c.depth for c in cases]], "begun": [begun], "objects": [[sorted(c.objects) for c in cases]]}, schema=SUMS)


SUMS = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("inside", pa.list_(pa.bool_())), ("depth", pa.list_(pa.int64())), ("begun", pa.list_(pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64())])))), ("objects", pa.list_(pa.list_(pa.int64())))])
SUMS_DDL = "file long, block long, size long, inside array<boolean>, depth array<long>, begun array<array<struct<depth: long, n: long>>>, objects array<array<long>>"


def _starts(spark: SparkSession, path: str) -> dict[tuple[int, int], tuple[bool, int, int]]:
    """State at the start of each byte range: inside a string, depth, elements begun. One row a range reaches the driver."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    files = listed.where("length > 0").select("path", "length", F.xxhash64("path").alias("file")).orderBy("path").collect()
    order, sizes = {r["file"]: k for k, r in enumerate(files)}, {r["file"]: r["length"] for r in files}
    rows = _fragments(spark, path).mapInArrow(_sums, SUMS_DDL).collect()
    inside, depth, begun, out = False, 0, 0, {}
    for r in sorted(rows, key=lambda r: (order[r["file"]], r["block"])):
        out[r["file"], r["block"]] = inside, depth, begun
        sizes[r["file"]] -= r["size"]
        case = int(inside)
        if case >= len(r["inside"]):
            raise ValueError(f"a file ends inside a string: {path}")
        if 1 - depth in r["objects"][case]:
            raise ValueError(f"an object stands outside an array, so it is no JSON array: {path}")
        begun += sum(b["n"] for b in r["begun"][case] if b["depth"] == 1 - depth)
        inside, depth = r["inside"][case], depth + r["depth"][case]
        if depth < 0:
            raise ValueError(f"more is closed than was opened: {path}")
    if any(left not in (0, BOM_BYTES) for left in sizes.values()):  # a brace at the very end has no fragment behind it
        raise ValueError(f"a file ends with a brace, so it is no JSON array: {path}")
    if inside or depth:
        raise ValueError(f"an array doesn't end: {path}")
    return out


def _cut(fragments: Iterator[bytes], inside: bool, depth: int, begun: int):
    """(number, opens, closes, whole, text) of the elements of a range, and of the parts of elements at its borders."""
    text, opens, whole = [], False, False
    for fragment in fragments:
        at = start = 0
        if inside:
            end = STRING_END.match(fragment)
            at, inside = (end.end(), False) if end else (len(fragment), True)
        while not inside and (m := TOKEN.search(fragment, at)):
            c, at = fragment[m.start()], m.end()
            if m.end() - m.start() > 1 and depth:
                continue
            if not depth:
                if c != 0x5B or fragment[start : m.start()].strip(BLANK_BYTES):
                    raise ValueError("expected a JSON array")
                depth, begun, opens, whole, start = 1, begun + 1, True, True, at
            elif c == 0x22:
                inside = True
            elif c in b"[{":
                depth += 1
            elif c in b"]}":
                depth -= 1
                if not depth:
                    text.append(fragment[start : m.start()])
                    yield begun - 1, opens, True, whole, b"".join(text)
                    text, start, opens, whole = [], at, False, False
            elif depth == 1:
                text.append(fragment[start : m.start()])
                yield begun - 1, opens, False, whole, b"".join(text)
                text, begun, start, opens, whole = [], begun + 1, at, False, True
        if depth:
            text.append(fragment[start:])
        elif fragment[start:].strip(BLANK_BYTES):
            raise ValueError("expected a JSON array")
    if depth:
        yield begun - 1, opens, False, False, b"".join(text)


PARTS = pa.schema([("block", pa.int64()), ("order", pa.int64()), ("number", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("whole", pa.bool_()), ("value", pa.string())])


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(number, value): the elements of the arrays at a path, as JSON text, numbered in order."""
    starts = _starts(spark, path)
    rank = {key: k for k, key in enumerate(starts)}  # in order of files and offsets
    shared = spark.sparkContext.broadcast((starts, rank))

    def run(batches):
        starts, rank = shared.value
        held, size = [], 0
        for file, block, fragments in _ranges(batches):
            if (file, block) not in starts:
                raise RuntimeError("the files' byte ranges have changed since they were looked at")
            for number, opens, closes, whole, text in _cut(fragments, *starts[file, block]):
                if whole and not text.strip(BLANK_BYTES):
                    if opens and closes:
                        continue
                    raise ValueError("an element is missing")
                held.append((block, rank[file, block], number, opens, closes, whole, text))
                size += len(text)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), PARTS.types)], schema=PARTS)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), PARTS.types)], schema=PARTS)

    parts = _fragments(spark, path).mapInArrow(run, "block long, order long, number long, opens boolean, closes boolean, whole boolean, value string")
    # parts of one element: as many as the ranges that it reaches into
    pieces = parts.where("not whole").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("order", "value"))).alias("p"), F.bool_or("opens").alias("opens"), F.bool_or("closes").alias("closes"))
    joined = pieces.select("number", "opens", "closes", F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"))
    blank = F.col("value").rlike(BLANK.pattern)
    # behind the bracket that ends an array nothing is open, so a part is blank only if its element is
    told = F.when(blank & ~(F.col("opens") & F.col("closes")), F.raise_error(F.lit("an element is missing"))).otherwise(F.col("value"))
    joined = joined.where(~(blank & F.col("opens") & F.col("closes"))).select("number", told.alias("value"))
    return parts.where("whole").select("number", "value").unionByName(joined)


def write_elements(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``lines(value)``, JSON texts, as one array at ``path``, in the order of partitions and rows."""
    if mode not in ("errorifexists", "error", "overwrite", "ignore"):
        raise ValueError(f"an array can't be written by mode {mode}")
    spark = lines.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and mode != "overwrite":
        if mode == "ignore":
            return
        raise FileExistsError(path)
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
    try:
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        lines.select(F.concat(F.when(first, "").otherwise(","), F.col("value")).alias("value")).write.text(aside.toString())
        parts = []
        for s in fs.listStatus(aside):
            if s.getPath().getName().startswith("part-"):
                if s.getLen():
                    parts.append(s.getPath().getName())
                else:
                    fs.delete(s.getPath(), False)

        def put(name: str, text: str) -> None:
            out = fs.create(jvm.org.apache.hadoop.fs.Path(aside, name))
            out.write(bytearray(text.encode()))
            out.close()

        put("part-.open", "[\n")
        for name in sorted(parts)[:-1]:
            put(f"{name}.then", ",\n")
        put("part-~close", "]\n")
        if fs.exists(target):
            old = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}-old-{uuid.uuid4().hex}")
            fs.rename(target, old)
            fs.rename(aside, target)
            fs.delete(old, True)
        elif not fs.rename(aside, target):
            raise OSError(f"could not rename {aside} to {path}")
    finally:
        fs.delete(aside, True)


def write_array(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as one JSON array; null fields are written."""
    write_elements(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")), path, mode)
