"""Samples, heads and size-limited context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.project import keep_essential, truncate_text
from emberlake.spec import CollectionSpec


def sample_order(keys: Sequence[str], seed: int = 42) -> Column:
    """A pseudo-random order fixed by key and seed, the same on every run and every cluster."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample_rows(df: DataFrame, keys: Sequence[str], size: int = 500, seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows, or all when there are fewer, as a top-n over the sample order."""
    return df.orderBy(sample_order(keys, seed), *keys).limit(size)


def basic_context(df: DataFrame, keys: Sequence[str], columns: Sequence[str], size: int = 10) -> DataFrame:
    """Sampled rows with the named columns."""
    return sample_rows(df, keys, size).select(*columns)


def optimised_context(df: DataFrame, spec: CollectionSpec | None, keys: Sequence[str]) -> DataFrame:
    """Sampled rows, chosen columns, cut text, as the collection's description asks; without one all columns."""
    if spec is None:
        return basic_context(df, keys, df.columns)
    lengths = {e.column: e.max_length for e in spec.dictionary if e.max_length}
    return truncate_text(
        keep_essential(sample_rows(df, keys, spec.max_rows), spec), lengths, spec.max_field_length
    )


def head(df: DataFrame, size: int = 1000, order: Sequence[str] = ()) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(size)


def newest(df: DataFrame, moment: str, tie: Sequence[str], size: int = 5) -> DataFrame:
    return df.orderBy(F.desc(moment), *tie).limit(size)
