"""Energy-certificate reports. Null keys never form a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions.quantiles import grouped_quantiles
from emberlake.operators.profile import value_counts
from emberlake.operators.project import numeric_columns, with_month_start, with_year_month, with_year_month_label


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def mean_by(df: DataFrame, key: str, measure: str, name: str | None = None) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(measure).alias(name or f"avg_{measure}"))


def most_frequent(df: DataFrame, key: str, limit: int) -> DataFrame:
    return count_by(df, key).orderBy(F.desc("count"), key).limit(limit)


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, count`` for many category columns in one pass."""
    return value_counts(df, columns, keep_null=False)


def category_sizes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per category column, on top of the same counts."""
    return category_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))


def monthly_changes(df: DataFrame, date_column: str, measures: Mapping[str, str], counted: str | None = None, axis: str = "date") -> DataFrame:
    """Rows, mean and exact median of each measure per month.

    ``measures`` maps a measure column to its output name; ``counted`` is the column whose non-null
    rows are counted (all rows when not given). ``axis`` is ``date`` or ``year_month``.
    """
    months = with_year_month(df, date_column)
    total = F.count(counted) if counted else F.count(F.lit(1))
    keys = ["lodgement_year", "lodgement_month"]
    long = grouped_quantiles(months, keys, list(measures), [0.5], {"total_certificates": total})

    def of(measure: str, value: Column) -> Column:
        return F.max(F.when(F.col("measure") == measure, value))

    wide = long.groupBy(*keys).agg(
        F.any_value("total_certificates").alias("total_certificates"),
        *[of(m, F.col("mean")).alias(f"avg_{name}") for m, name in measures.items()],
        *[of(m, F.col("q")[0]).alias(f"median_{name}") for m, name in measures.items()],
    )
    add = with_month_start if axis == "date" else with_year_month_label
    return add(wide, *keys)


def metric_means(df: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """Global means as ``metric, value`` rows."""
    rows = [F.struct(F.lit(name).alias("metric"), F.avg(column).alias("value")) for column, name in measures.items()]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def yearly_mean(df: DataFrame, date_column: str, measure: str) -> DataFrame:
    return mean_by(with_year_month(df, date_column), "lodgement_year", measure)


def shares(df: DataFrame, key: str) -> DataFrame:
    """Counts per value with their percent of all non-null rows; the total is a one-row subquery."""
    total = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1))).scalar()
    return count_by(df, key).withColumn("percent", F.col("count") * 100.0 / total)


def paired_distribution(df: DataFrame, current: str, potential: str) -> DataFrame:
    """``kind, rating, count`` of two rating columns."""
    pair = df.select(F.col(current).cast("string").alias("current"), F.col(potential).cast("string").alias("potential"))
    return value_counts(pair, ["current", "potential"], keep_null=False).select(F.col("column").alias("kind"), F.col("value").alias("rating"), "count")


def yearly_ratings(df: DataFrame, date_column: str, rating: str) -> DataFrame:
    return count_by(with_year_month(df, date_column), "lodgement_year", rating)


def group_summary(df: DataFrame, key: str) -> DataFrame:
    """Mean and count of every numeric column per group."""
    numbers = [c for c in numeric_columns(df) if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in numbers], *[F.count(c).alias(f"count_{c}") for c in numbers]
    )
