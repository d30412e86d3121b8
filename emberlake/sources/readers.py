"""Readers. Schemas are explicit wherever a format does not carry one."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.operators.filters import in_date_range
from emberlake.spec import TableSpec

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".orc": "orc"}
UNSUPPORTED = {".xlsx": "convert the sheet to CSV", ".feather": "convert the file to Parquet"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_tables(spark: SparkSession, folder: str, names: Sequence[str] = TABLE_NAMES) -> None:
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, params: Mapping[str, Any] | None = None) -> DataFrame:
    """A SQL text over the registered views. Parameters are bound, never pasted into the text."""
    return spark.sql(text, args=dict(params or {}))


def read_jdbc(
    spark: SparkSession, url: str, table_or_query: str, *, key: str | None = None, bounds: tuple[int, int] | None = None,
    partitions: int = 8, **options: str,
) -> DataFrame:
    """An external table; with a numeric key and its bounds it is read in parallel key ranges.

    This also reads a layer of a GeoPackage, which is a SQLite file, given that driver.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table_or_query, **options)
    if key and bounds:
        reader = reader.options(
            partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)
        )
    return reader.load()


def scan_vectors(df: DataFrame, spec: TableSpec, keys: Sequence[str], date_range: tuple[Any, Any] | None = None, vector_column: str = "embedding") -> DataFrame:
    """Keys, vector and date, with an optional inclusive range that reaches the scan."""
    rows = in_date_range(df, spec, *date_range) if date_range else df
    extra = [spec.date_column] if spec.date_column and spec.date_column in df.columns else []
    return rows.select(*dict.fromkeys([*keys, vector_column, *extra]))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", False)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By file ending; formats that Spark cannot read are refused with advice."""
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending in UNSUPPORTED:
        raise ValueError(f"{ending} has no Spark reader: {UNSUPPORTED[ending]}")
    if ending not in FORMATS:
        raise ValueError(f"unknown file ending: {ending or path}")
    if FORMATS[ending] == "csv":
        return read_csv(spark, path, schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(FORMATS[ending]).load(path)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every Parquet file of a folder."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)


def read_lake_table(spark: SparkSession, name_or_path: str, format: str = "parquet", limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """A table or view of the session's catalog, or a path in a lake format; Delta works where its package is installed.

    A limit takes the first rows in the given order.
    """
    df = spark.read.format(format).load(name_or_path) if "/" in name_or_path else spark.read.table(name_or_path)
    if limit is None:
        return df
    if not order:
        raise ValueError("a limit needs an order")
    return df.orderBy(*order).limit(limit)


def read_documents(df: DataFrame, where: Column | None = None, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """All documents that meet the condition; a limit takes the first in the given order."""
    rows = df if where is None else df.where(where)
    if limit is not None:
        if not order:
            raise ValueError("a limit needs an order")
        rows = rows.orderBy(*order).limit(limit)
    return rows.drop("_id")


def response_items(df: DataFrame, table_name: str) -> DataFrame:
    """Rows of landed responses ``{data: {<table>: {items: [...]}}}``."""
    return df.select(F.explode(F.col(f"data.{table_name}.items")).alias("item")).select("item.*")


def try_json(column: Column) -> Column:
    """JSON text in its normal form; text that is no JSON stays as it is."""
    return F.coalesce(F.try_parse_json(column).cast("string"), column)


def preview(df: DataFrame, spec: TableSpec, date_range: tuple[Any, Any] | None = None, order: Sequence[str] = (), limit: int = 1000) -> DataFrame:
    rows = in_date_range(df, spec, *date_range) if date_range else df
    return (rows.orderBy(*order) if order else rows).limit(limit)
