"""Writers. Each is one distributed write; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.operators.points import table_fingerprint
from emberlake.operators.vector import vector_size


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_tables(df: DataFrame, path: str, by: str, format: str = "parquet") -> None:
    """One folder per table name in column ``by``."""
    df.write.mode("overwrite").partitionBy(by).format(format).option("header", True).save(path)


def append_merging(df: DataFrame, path: str) -> None:
    """Append rows whose columns may differ from earlier ones; read with ``read_merged``."""
    df.write.mode("append").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def create_collection(df: DataFrame, path: str, vector_column: str = "embedding") -> int:
    """Write a new collection after checking that all vectors have one size; returns that size."""
    size = vector_size(df, vector_column)
    overwrite(df, path)
    return size


def audit_row(df: DataFrame, path: str, question: str, code: str, retry: bool = False) -> DataFrame:
    """Append one audit row about a result: time, question, code, rows, columns."""
    row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.current_timestamp().alias("logged_at"), F.lit(question).alias("question"), F.lit(code).alias("code"), "row_count",
        F.lit(len(df.columns)).alias("column_count"), F.lit(",".join(df.columns)).alias("columns"), F.lit(retry).alias("is_retry"),
    )
    row.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def insert_documents(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def copy_collections(points: DataFrame, path: str, collections: Sequence[str] | None = None, column: str = "collection") -> bool:
    """Copy the chosen collections and compare row count and checksum of copy and origin."""
    chosen = points if collections is None else points.where(F.col(column).isin(list(collections)))
    chosen.write.mode("overwrite").partitionBy(column).parquet(path)
    copied = points.sparkSession.read.schema(points.schema).parquet(path).select(*points.columns)
    return table_fingerprint(chosen).first() == table_fingerprint(copied).first()
