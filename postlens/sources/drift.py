"""What fields JSON lines really have, over all files, and where files disagree.

Inference from one file misses what only others hold. Here every line is parsed as a
variant and taken apart level by level: the fields of objects, then those of the objects
in them, and so on, one pass over the values per level of nesting. Only counts by path and
kind of value are shuffled; what reaches the driver is a row for each of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Stands for the elements of an array in a path.
ELEMENT = "[]"

_PLAIN = {"BIGINT": LongType(), "DOUBLE": DoubleType(), "STRING": StringType(), "BOOLEAN": BooleanType()}


def _kind(value: Column) -> Column:
    """BIGINT, DOUBLE for any other number, STRING, BOOLEAN, OBJECT, ARRAY or VOID."""
    kind = F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)
    return F.when(kind.isin("DECIMAL", "FLOAT"), "DOUBLE").otherwise(kind)


def field_kinds(spark: SparkSession, path: str) -> DataFrame:
    """`path, kind, n_values, n_files, first_file` of the values in all lines below `path`.

    `path` lists the names that lead to a value; the elements of an array share one entry,
    `[]`. A line that is no JSON has no values; one that is, but is no object, has the empty
    path. Blank lines are no JSON. Without lines there are no rows.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    level = lines.select(
        "file", F.array().cast("array<string>").alias("path"), F.try_parse_json("value").alias("value")
    ).where("value IS NOT NULL")
    kinds = None
    while True:
        level = level.withColumn("kind", _kind(F.col("value")))
        found = level.groupBy("path", "kind", "file").agg(F.count(F.lit(1)).alias("n"))
        found = found.groupBy("path", "kind").agg(
            F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_files"), F.min("file").alias("first_file")
        )
        rows = found.collect()
        kinds = (kinds or []) + [tuple(row) for row in rows]
        if not any(row["kind"] in ("OBJECT", "ARRAY") for row in rows):
            break
        below = level.where(F.col("kind").isin("OBJECT", "ARRAY"))
        below = below.select("file", F.col("path").alias("above"), F.col("value").alias("held"))
        below = below.lateralJoin(spark.tvf.variant_explode(F.col("held").outer()))
        step = F.array(F.coalesce("key", F.lit(ELEMENT)))
        level = below.select("file", F.concat("above", step).alias("path"), "value")
    schema = "path array<string>, kind string, n_values bigint, n_files bigint, first_file string"
    return spark.createDataFrame([row for row in kinds if row[0] or row[1] != "OBJECT"], schema)


def schema_drift(kinds: DataFrame) -> DataFrame:
    """One row per path: `path`, `kinds` in order, `n_values`, `n_files` and `conflict`.

    Kinds conflict if no one type holds them all; whole and other numbers do not, and
    NULLs conflict with nothing. `n_files` is that of the most frequent kind.
    """
    real = F.when(F.col("kind") != "VOID", F.when(F.col("kind").isin("BIGINT", "DOUBLE"), "NUMBER").otherwise(F.col("kind")))
    return kinds.groupBy("path").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.sum("n_values").alias("n_values"),
        F.max("n_files").alias("n_files"),
        (F.count_distinct(real) > 1).alias("conflict"),
    )


def merged_schema(kinds: DataFrame) -> StructType:
    """The schema that reads every line: fields by name, STRING where kinds conflict.

    Fields that are only ever NULL are strings.
    """
    found: dict[tuple[str, ...], set[str]] = {}
    for row in kinds.collect():
        found.setdefault(tuple(row["path"]), set()).add(row["kind"])
    return _struct(found, ())


def _struct(found: dict[tuple[str, ...], set[str]], path: tuple[str, ...]) -> StructType:
    names = sorted(p[-1] for p in found if len(p) == len(path) + 1 and p[:-1] == path and p[-1] != ELEMENT)
    return StructType([StructField(name, _type(found, (*path, name))) for name in names])


def _type(found: dict[tuple[str, ...], set[str]], path: tuple[str, ...]) -> DataType:
    kinds = found.get(path, set()) - {"VOID"}
    if kinds == {"BIGINT", "DOUBLE"}:
        return DoubleType()
    if kinds == {"OBJECT"}:
        fields = _struct(found, path)
        return fields if fields.fields else StringType()
    if kinds == {"ARRAY"}:
        return ArrayType(_type(found, (*path, ELEMENT)))
    return _PLAIN.get(next(iter(kinds)), StringType()) if len(kinds) == 1 else StringType()
