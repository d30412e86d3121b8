"""The keyed vector table: build, upsert, copy, check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.combine import newest_per_key
from emberlake.operators.project import payload as payload_of


def as_points(df: DataFrame, id_column: str, vector_column: str = "embedding") -> DataFrame:
    """``id, vector, payload`` rows; the payload is everything but the vector."""
    return df.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"), payload_of(df, vector_column).alias("payload"))


def upsert(old: DataFrame, new: DataFrame, id_column: str, order: Sequence[Column] = ()) -> DataFrame:
    """Old rows without a newer version, plus the new rows.

    ``order`` sorts several new rows of one id, best first. Old rows meet only the ids of the new
    batch: the old table is not sorted, and a small batch is broadcast by Spark.
    """
    batch = newest_per_key(new, [id_column], order, 1) if order else new.dropDuplicates([id_column])
    kept = old.join(batch.select(id_column), id_column, "left_anti")
    return kept.unionByName(batch)


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-free checksum, to compare a copy with its origin."""
    names = list(columns or df.columns)
    # A decimal sum neither overflows nor depends on the order of the rows.
    hashed = F.xxhash64(*names).cast("decimal(28,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(hashed), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))
