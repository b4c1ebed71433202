"""Records of mixed shape, kept as they are: ids that are numbers or texts, media that are one path or a list, any metadata.

A record is one variant. Its parts are read by path with the type they have there; nothing is
forced into text, so what is written back is what was read, but for the order of an object's keys, which is that of their names. What is no JSON has a null record beside its line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.arrays import read_elements
from quillon.sources.records import numbered_lines

#: First word of a variant's schema, and what JSON calls such a value.
KINDS = {"BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object", "VOID": "null"}


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines: (source_file, line, value, record); the record of a bad line is null."""
    return numbered_lines(spark, path).withColumn("record", F.try_parse_json("value"))


def read_variant_array(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays: (number, record) of each element."""
    return read_elements(spark, path).select("number", F.parse_json("value").alias("record"))


def write_variants(df: DataFrame, path: str, record: str = "record", mode: str = "errorifexists") -> None:
    """One line a record, as JSON."""
    df.select(F.to_json(record).alias("value")).write.mode(mode).text(path)


def part(record: Column, path: str) -> Column:
    """The value at a path ('$.metadata.id'), null if it is absent."""
    return F.try_variant_get(record, path, "variant")


def kind(value: Column) -> Column:
    """'number', 'string', 'boolean', 'array', 'object' or 'null', as JSON has it; null if absent."""
    first = F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)
    return F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), first)


def as_text(value: Column) -> Column:
    """A text as it is, anything else as JSON; null if absent or null."""
    return F.when(kind(value) == "string", F.try_variant_get(value, "$", "string")).when(kind(value) != "null", F.to_json(value))


def media(record: Column, *paths: str) -> Column:
    """Paths of the first field that is there: one text, or a list of texts."""
    found = F.coalesce(*[F.when(F.coalesce(kind(part(record, p)) != "null", F.lit(False)), part(record, p)) for p in paths])
    listed = F.coalesce(F.try_variant_get(found, "$", "array<string>"), F.array().cast("array<string>"))
    return F.when(kind(found) == "string", F.array(as_text(found))).otherwise(listed)


def with_part(record: Column, fields: dict[str, Column]) -> Column:
    """A record made of fields; each keeps its type, variants theirs."""
    return F.to_variant_object(F.struct(*[c.alias(k) for k, c in fields.items()]))


def shape(df: DataFrame, record: str = "record") -> DataFrame:
    """One row: the schema that holds all records."""
    return df.agg(F.schema_of_variant_agg(record).alias("shape"))
