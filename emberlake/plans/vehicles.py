"""Vehicle reports: the best row, the top rows, the spread of one measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.functions.quantiles import grouped_quantiles


def best_row(df: DataFrame, measure: str, key: str) -> DataFrame:
    """The whole row with the largest value; the smaller key wins a tie."""
    return top_rows(df, measure, key, 1)


def top_rows(df: DataFrame, measure: str, key: str, limit: int = 5) -> DataFrame:
    return df.where(F.col(measure).isNotNull()).orderBy(F.desc(measure), key).limit(limit)


def spread(df: DataFrame, measure: str) -> DataFrame:
    return grouped_quantiles(df, [], [measure], [0.5]).select(
        "mean", F.col("q")[0].alias("median"), "std", F.col("low").alias("min"), F.col("high").alias("max")
    )
