"""Unpacking of structs, maps, arrays and JSON text into plain columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.functions.parsing import json_like
from emberlake.operators.profile import per_column
from emberlake.operators.project import string_columns

SCALARS = (T.StringType, T.NumericType, T.BooleanType)


def unpack_struct(df: DataFrame, column: str) -> DataFrame:
    fields = df.schema[column].dataType.fieldNames()
    return df.withColumns({f"{column}_{f}": F.col(column).getField(f) for f in fields})


def map_keys_of(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """All keys of a map column, sorted: one per column of the result. More than ``most`` of them are an error, as such a
    map is no set of columns; use ``map_entries`` for it."""
    keys = sorted(str(r.k) for r in df.select(F.explode(F.map_keys(column)).alias("k")).distinct().limit(most + 1).collect())
    if len(keys) > most:
        raise ValueError(f"{column} has more than {most} keys")
    return keys


def map_entries(df: DataFrame, column: str) -> DataFrame:
    """The map's entries as rows ``<column>_key, <column>_value`` beside the other columns, for any number of keys."""
    return df.select(*[c for c in df.columns if c != column], F.explode_outer(column).alias(f"{column}_key", f"{column}_value"))


def unpack_map(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """One column ``<column>_<key>`` per key; the map stays."""
    names = map_keys_of(df, column) if keys is None else keys
    return df.withColumns({f"{column}_{k}": F.try_element_at(F.col(column), F.lit(k)) for k in names})


def join_array(df: DataFrame, column: str) -> DataFrame:
    """``<column>_joined``: the elements as text with ``" | "`` between; empty arrays give null."""
    text = F.array_join(F.transform(column, lambda x: x.cast("string")), " | ", "None")
    return df.withColumn(f"{column}_joined", F.when(F.size(column) > 0, text))


def json_schema(df: DataFrame, column: str) -> str | None:
    """The merged schema of a JSON text column as DDL, null when it holds no objects.

    One row comes back, whose size is that of the schema.
    """
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first().s
    if not found or not found.startswith("OBJECT<"):
        return None
    return re.sub(r"\bVOID\b", "STRING", found.replace("OBJECT<", "STRUCT<"))


def unpack_json(df: DataFrame, column: str, schema: str | None = None) -> DataFrame:
    """One column ``<column>_<field>`` per field of a JSON text column; the text stays."""
    ddl = schema or json_schema(df, column)
    if ddl is None:
        return df
    parsed = df.withColumn("__json", F.from_json(column, ddl))
    fields = parsed.schema["__json"].dataType.fieldNames()
    return parsed.withColumns({f"{column}_{f}": F.col("__json").getField(f) for f in fields}).drop("__json")


def json_text_columns(df: DataFrame) -> list[str]:
    """Text columns whose filled values all look like JSON objects or arrays."""
    names = string_columns(df)
    if not names:
        return []
    rows = per_column(df, names, {
        "filled": F.count, "json": lambda c: F.count_if(json_like(F.col(c)))
    }).collect()
    return [r["column"] for r in rows if r["filled"] and r["json"] == r["filled"]]


def unpack(df: DataFrame, json_columns: list[str] | None = None) -> DataFrame:
    """Unpack every nested column of the schema, and the JSON text columns."""
    names = json_text_columns(df) if json_columns is None else json_columns
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            df = unpack_struct(df, f.name)
        elif isinstance(f.dataType, T.MapType) and isinstance(f.dataType.keyType, T.StringType):
            df = unpack_map(df, f.name)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, SCALARS):
            df = join_array(df, f.name)
    for name in names:
        df = unpack_json(df, name)
    return df


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """All struct levels as plain columns, the structs themselves gone."""
    def leaves(prefix: str, column: Column, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in leaves(f"{prefix}{separator}{f.name}", column.getField(f.name), f.dataType)]
        return [column.alias(prefix)]

    return df.select(*[x for f in df.schema for x in leaves(f.name, F.col(f.name), f.dataType)])


def explode_items(df: DataFrame, column: str) -> DataFrame:
    """One row per array element; rows with no element stay with null."""
    return df.withColumn(column, F.explode_outer(column))
