"""Work that continues where the last run ended: used ids and training pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.operators.project import stable_id


def with_id(df: DataFrame, id_columns: Sequence[str] = (), name: str = "row_key") -> DataFrame:
    """The given key columns joined by ``-``, or a hash of the row."""
    return df.withColumn(name, stable_id(df, list(id_columns)))


def new_rows(df: DataFrame, tracker: DataFrame, table: str, kind: str, key: str = "row_key") -> DataFrame:
    """Rows whose key the tracker (``table, kind, row_key``) does not list."""
    used = tracker.where((F.col("table") == table) & (F.col("kind") == kind)).select(F.col("row_key").alias(key))
    return df.join(used, key, "left_anti")


def tracker_rows(df: DataFrame, table: str, kind: str, key: str = "row_key") -> DataFrame:
    """The keys of newly used rows, in the tracker's shape."""
    return df.select(F.lit(table).alias("table"), F.lit(kind).alias("kind"), F.col(key).alias("row_key")).distinct()


def training_pairs(df: DataFrame, pair: Sequence[str] = ("question", "answer")) -> DataFrame:
    """``text1, text2, label`` of the two named columns."""
    if len(pair) != 2 or not set(pair) <= set(df.columns):
        raise ValueError("two columns are needed for a pair")
    return df.select(F.col(pair[0]).cast("string").alias("text1"), F.col(pair[1]).cast("string").alias("text2"), F.lit(1.0).alias("label"))
