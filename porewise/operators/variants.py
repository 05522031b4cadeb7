"""Columns of JSON text without a fixed schema: what paths and types there are, and typed values of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize

#: Names of the types of JSON, by how the engine's type of a value begins.
KINDS = {"BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "text", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "VOID": "null"}


def kind_of(value: Column) -> Column:
    """The type of a variant by name; a null that is JSON's own is ``null``, one of the table is no value and has no type."""
    told = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), told)


def stored(rows: DataFrame, text: str, name: str = "variants") -> DataFrame:
    """The rows as a written table, with ``v``: the text as a variant, null where there is none or it is malformed, and ``malformed``.

    Text is parsed once; from the table, a path's values are read without it.
    """
    parsed = F.try_parse_json(text)
    return materialize(rows.withColumn("v", parsed).withColumn("malformed", F.col(text).isNotNull() & F.col("v").isNull()).drop(text), name)


def path_kinds(variants: DataFrame) -> DataFrame:
    """(path, kind, n): how many objects have each key with each type of value; ``$`` counts the values as wholes.

    A key that stands twice in an object counts as the parser keeps it, once.
    """
    whole = variants.where("v is not null").select(F.lit("$").alias("path"), kind_of(F.col("v")).alias("kind"))
    objects = variants.select(F.when(kind_of(F.col("v")) == "object", F.col("v")).alias("v")).where("v is not null")
    keys = objects.lateralJoin(variants.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.concat(F.lit("$."), "key").alias("path"), kind_of(F.col("value")).alias("kind"))
    return whole.union(keys).groupBy("path", "kind").agg(F.count("*").alias("n"))


def typed(path: str, kind: str, variant: str = "v") -> Column:
    """The value at a path as a type; null where the path is missing or its value is no such thing."""
    return F.try_variant_get(variant, path, kind)
