"""Meter-reading reports over ``meterNo, fuelType, consumption, readingType, month, year``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.project import percent_ratio, unpivot_pair

REQUIRED = ("meterNo", "fuelType", "consumption", "readingType", "month", "year")


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED if c not in df.columns]


def meter_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("meterNo").alias("meters"))


def meters_by_fuel(df: DataFrame) -> DataFrame:
    return df.where(F.col("fuelType").isNotNull()).groupBy("fuelType").agg(F.count_distinct("meterNo").alias("meters"))


def _sum_of(kind: str) -> Column:
    return F.sum(F.when(F.col("readingType") == kind, F.col("consumption")))


def consumption_by(df: DataFrame, key: str) -> DataFrame:
    """Estimated and actual consumption per meter or fuel, and their ratio in percent."""
    sums = df.where(F.col(key).isNotNull()).groupBy(key).pivot("readingType", ["Estimated", "Actual"]).agg(F.sum("consumption"))
    return sums.withColumn("Estimated_vs_Actual", percent_ratio(F.col("Estimated"), F.col("Actual")))


def consumption_long(df: DataFrame, key: str = "fuelType") -> DataFrame:
    return unpivot_pair(consumption_by(df, key), [key], ["Estimated", "Actual"])


def overall_ratio(df: DataFrame) -> DataFrame:
    sums = df.agg(_sum_of("Estimated").alias("total_estimated"), _sum_of("Actual").alias("total_actual"))
    return sums.withColumn("overall_percent", percent_ratio(F.col("total_estimated"), F.col("total_actual")))


def coverage(df: DataFrame, expected_months: int) -> DataFrame:
    """Months available and missing and percent covered per meter.

    Distinct months are cut first (meter, year, month), so a meter with very many rows is reduced in
    every task before its months are counted.
    """
    months = df.select("meterNo", "year", "month").dropna().distinct()
    return months.groupBy("meterNo").agg(F.count(F.lit(1)).alias("months_available")).select(
        "meterNo", "months_available", (F.lit(expected_months) - F.col("months_available")).alias("months_missing"),
        F.round(F.col("months_available") * 100.0 / expected_months, 1).alias("coverage"),
    )


def coverage_summary(df: DataFrame, expected_months: int) -> DataFrame:
    return coverage(df, expected_months).agg(
        F.count(F.lit(1)).alias("meters"), F.count_if(F.col("months_available") == expected_months).alias("complete_meters"),
        F.round(F.avg("coverage"), 1).alias("average_coverage"),
    )


def meters_with_gaps(df: DataFrame) -> DataFrame:
    return df.where(F.col("consumption").isNull()).select("meterNo").distinct()


def gap_summary(df: DataFrame) -> DataFrame:
    per_meter = df.groupBy("meterNo").agg(F.bool_or(F.col("consumption").isNull()).alias("gap")).where(F.col("meterNo").isNotNull())
    return per_meter.agg(
        F.count_if("gap").alias("missing_meters"), F.count(F.lit(1)).alias("meters"),
        F.round(F.count_if("gap") * 100.0 / F.count(F.lit(1)), 1).alias("missing_percent"),
    )


def missing_records(df: DataFrame) -> DataFrame:
    gap = F.count_if(F.col("consumption").isNull())
    return df.agg(gap.alias("missing"), F.round(F.try_divide(gap * 100.0, F.count(F.lit(1))), 1).alias("missing_percent"))
