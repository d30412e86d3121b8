"""Profiles and data-quality measures.

Each report reads its table once where the measures allow it: all measures of all columns are one
aggregate whose single row is then laid out as one row per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.functions.parsing import OBJECT_ID, json_like, numeric_like, value_kind
from emberlake.functions.quantiles import grouped_quantiles
from emberlake.operators.combine import duplicate_count
from emberlake.operators.project import numeric_columns, string_columns


def per_column(df: DataFrame, columns: Sequence[str], measures: Mapping[str, Any]) -> DataFrame:
    """``column, *measures``: every measure is a function from a column name to an aggregate."""
    rows = [
        F.struct(F.lit(c).alias("column"), *[make(c).alias(name) for name, make in measures.items()])
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def value_counts(df: DataFrame, columns: Sequence[str], keep_null: bool = True) -> DataFrame:
    """``column, value, count`` for several columns, in one pass and one shuffle of partial counts."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], list(columns), "column", "value")
    if not keep_null:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def overview(df: DataFrame) -> DataFrame:
    return duplicate_count(df).select("rows", F.lit(len(df.columns)).alias("columns"), "duplicates")


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    counted = per_column(df, columns or df.columns, {
        "nulls": lambda c: F.count_if(F.col(c).isNull()),
        "total": lambda c: F.count(F.lit(1)),
    })
    return counted.select("column", "nulls", F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("total")), F.lit(0.0)).alias("null_percent"))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Count, mean, sample standard deviation, minimum, quartiles and maximum per numeric column."""
    columns = list(columns or numeric_columns(df))
    if approximate:
        rows = per_column(df, columns, {
            "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(c).cast("double"),
            "q": lambda c: F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], 10_000),
            "max": lambda c: F.max(c).cast("double"),
        })
        return rows.select(
            "column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"),
            F.col("q")[2].alias("q75"), "max",
        )
    return grouped_quantiles(df, [], columns, [0.25, 0.5, 0.75]).select(
        F.col("measure").alias("column"), F.col("n").alias("count"), "mean", "std", F.col("low").alias("min"),
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), F.col("high").alias("max"),
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5, keep_null: bool = True) -> DataFrame:
    counted = value_counts(df, list(columns or string_columns(df)), keep_null)
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.col("value").asc_nulls_last())
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def context_profile(df: DataFrame, categorical: Sequence[str] | None = None, values: int = 10, numeric: Sequence[str] | None = None) -> DataFrame:
    """The rows a context text is assembled from: frequent values, and minimum, maximum and mean."""
    names = string_columns(df) if categorical is None else list(categorical)
    numbers = numeric_columns(df) if numeric is None else list(numeric)
    parts = []
    if names:
        parts.append(top_values(df, names, values, keep_null=False).select(
            F.lit("value").alias("kind"), "column", "rank", "value", F.lit(None).cast("double").alias("number")
        ))
    if numbers:
        stats = per_column(df, numbers, {
            "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double"), "mean": F.avg,
        })
        parts.append(stats.unpivot("column", ["min", "max", "mean"], "value", "number").select(
            F.lit("statistic").alias("kind"), "column", F.lit(0).alias("rank"), "value", "number"
        ))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def context_text(profile: DataFrame) -> DataFrame:
    """The profile as one line per column; a column has at most ten values."""
    line = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "value", "number"))),
        lambda x: F.when(x["number"].isNull(), x["value"]).otherwise(F.format_string("%s=%.2f", x["value"], x["number"])),
    ), ", ")
    return profile.groupBy("kind", "column").agg(line.alias("line"))


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair, rows with a null in the pair left out; long form."""
    columns = list(columns or numeric_columns(df))
    rows = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))
        for a, b in combinations(columns, 2)
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def distribution_shape(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Bias-corrected sample skewness and excess kurtosis per column."""
    columns = list(columns or numeric_columns(df))
    raw = per_column(df, columns, {"n": F.count, "g1": F.skewness, "g2": F.kurtosis})
    n = F.col("n").cast("double")
    skew = F.try_divide(F.col("g1") * F.sqrt(n * (n - 1)), n - 2)
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return raw.select("column", F.round(skew, digits).alias("skewness"), F.round(kurt, digits).alias("kurtosis"))


def _outlier_counts(df: DataFrame, columns: Sequence[str], bounds: DataFrame) -> DataFrame:
    """Rows outside ``low, high`` per column. ``bounds`` has one row per column, so it is broadcast."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return long.join(F.broadcast(bounds), "column", "left").groupBy("column").agg(
        F.count_if(outside).alias("outliers"),
        F.round(F.count_if(outside) * 100.0 / F.count(F.lit(1)), 2).alias("outlier_percent"),
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    bounds = grouped_quantiles(df, [], columns, [0.25, 0.75]).select(
        F.col("measure").alias("column"), (q1 - (q3 - q1) * 1.5).alias("low"), (q3 + (q3 - q1) * 1.5).alias("high")
    )
    return _outlier_counts(df, columns, bounds)


def zscore_outliers(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 3.0) -> DataFrame:
    """Values further than ``limit`` population standard deviations from the mean; nulls are left out."""
    columns = list(columns or numeric_columns(df))
    stats = per_column(df, columns, {"mean": F.avg, "std": F.stddev_pop})
    bounds = stats.select(
        "column", (F.col("mean") - F.col("std") * limit).alias("low"), (F.col("mean") + F.col("std") * limit).alias("high")
    )
    return _outlier_counts(df, columns, bounds)


def insights(df: DataFrame, null_limit: float = 30.0, skew_limit: float = 1.0) -> DataFrame:
    """``rule, column`` for columns with many nulls, strong skew, or a single value.

    A column is constant when its least and greatest value agree, so no distinct count is needed.
    """
    orderable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    numbers = set(numeric_columns(df))

    def skew(c: str) -> Column:
        return F.abs(F.skewness(c)) if c in numbers else F.lit(None).cast("double")

    measured = per_column(df, df.columns, {
        "null_percent": lambda c: F.count_if(F.col(c).isNull()) * 100.0 / F.count(F.lit(1)),
        "skew": skew,
        "constant": lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(False)) if c in orderable else F.lit(False),
    })
    rules = F.array_compact(F.array(
        F.when(F.col("null_percent") > null_limit, F.lit("high_missing")),
        F.when(F.col("skew") > skew_limit, F.lit("skewed")),
        F.when(F.col("constant"), F.lit("constant")),
    ))
    return measured.select(F.explode(rules).alias("rule"), "column")


def means_by_date(df: DataFrame, date_column: str, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    return df.where(F.col(date_column).isNotNull()).groupBy(date_column).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def mentioned_columns(df: DataFrame, question: str) -> list[str]:
    return [c for c in df.columns if c.lower() in question.lower()]


def profile_for_question(df: DataFrame, question: str) -> dict[str, DataFrame]:
    """Profiles of the columns the question names: what is asked decides which reports are built."""
    named = mentioned_columns(df, question)
    numbers = [c for c in named if c in numeric_columns(df)]
    dates = [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    reports: dict[str, DataFrame] = {}
    if numbers:
        reports["summary_stats"] = describe_numeric(df, numbers)
        reports["distributions"] = distribution_shape(df, numbers)
        reports["outliers"] = iqr_outliers(df, numbers)
    if len(numbers) > 1:
        reports["correlations"] = correlations(df, numbers)
    if named:
        reports["missing_values"] = null_report(df, named)
    if numbers and dates:
        reports["trends"] = means_by_date(df, dates[0], numbers)
    return reports


def quality_report(df: DataFrame) -> DataFrame:
    """One row per column and one for the table: null percent, distinct share, score, advice."""
    kinds = {f.name: f.dataType for f in df.schema}
    arrays = {c for c, k in kinds.items() if isinstance(k, T.ArrayType)}
    texts = [c for c, k in kinds.items() if isinstance(k, T.StringType)]
    nulls = per_column(df, df.columns, {
        "nulls": lambda c: F.count_if(F.col(c).isNull()),
        "total": lambda c: F.count(F.lit(1)),
        "is_array": lambda c: F.lit(c in arrays),
        "is_text": lambda c: F.lit(c in texts),
    }).withColumn("null_share", F.try_divide(F.col("nulls").cast("double"), F.col("total")))
    if texts:
        distinct = value_counts(df, texts, keep_null=False).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
        measured = nulls.join(F.broadcast(distinct), "column", "left")  # one row per text column
    else:
        measured = nulls.withColumn("distinct", F.lit(None).cast("long"))
    share = F.when(F.col("is_text"), F.try_divide(F.coalesce("distinct", F.lit(0)).cast("double"), F.col("total")))
    advice = F.concat_ws("; ", F.array_compact(F.array(
        F.when(~F.col("is_array") & (F.col("null_share") > 0.5), F.lit("many missing values")),
        F.when(F.col("is_text") & (F.col("null_share") < 0.2) & (share < 0.1), F.lit("low cardinality")),
    )))
    columns = measured.select(
        "column", "nulls", (F.col("null_share") * 100).alias("null_percent"), share.alias("distinct_share"),
        F.when(~F.col("is_array"), 1 - F.col("null_share")).alias("score"), advice.alias("advice"),
    )
    table = columns.agg(
        F.lit("*").alias("column"), F.sum("nulls").alias("nulls"), F.avg("null_percent").alias("null_percent"),
        F.lit(None).cast("double").alias("distinct_share"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"),
    ).withColumn("advice", F.when(F.col("score") < 0.7, F.lit("low overall quality")).otherwise(F.lit("")))
    return columns.unionByName(table)


def array_lengths(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)])

    def length(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.size(c))

    return per_column(df, columns, {
        "min_length": lambda c: F.min(length(c)), "max_length": lambda c: F.max(length(c)),
        "avg_length": lambda c: F.avg(length(c)),
    })


def value_shapes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Percent of object ids and of JSON-looking values, and the number of value kinds, per text column."""
    columns = list(columns or string_columns(df))
    kinds = ("integer", "number", "boolean", "array", "object", "text")

    def percent(condition: Column, c: str) -> Column:
        return F.coalesce(F.try_divide(F.count_if(condition) * 100.0, F.count(c)), F.lit(0.0))

    return per_column(df, columns, {
        "object_id_percent": lambda c: percent(F.col(c).rlike(OBJECT_ID), c),
        "json_percent": lambda c: percent(json_like(F.col(c)), c),
        "kinds": lambda c: sum(
            (F.bool_or(value_kind(F.col(c)) == k).cast("int") for k in kinds[1:]), F.bool_or(value_kind(F.col(c)) == kinds[0]).cast("int")
        ),
    }).withColumn("mixed", F.coalesce(F.col("kinds") > 2, F.lit(False)))


def numeric_likeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Percent of non-null values that are numbers once a unit is taken off."""
    columns = list(columns or string_columns(df))
    rows = per_column(df, columns, {
        "numeric_percent": lambda c: F.coalesce(
            F.try_divide(F.count_if(numeric_like(F.col(c))) * 100.0, F.count(c)), F.lit(0.0)
        ),
    })
    return rows.withColumn("should_be_numeric", F.col("numeric_percent") > 50)


def collection_info(df: DataFrame, name: str) -> DataFrame:
    """Row count, field names, mean and total size of the rows written as JSON, over all rows."""
    size = F.length(F.to_json(F.struct(*df.columns)))
    return df.agg(F.count(F.lit(1)).alias("documents"), F.avg(size).alias("avg_size"), F.sum(size).alias("total_size")).select(
        F.lit(name).alias("collection"), "documents", F.lit(",".join(df.columns)).alias("fields"), "avg_size", "total_size"
    )


def readable_size(size: Column) -> Column:
    """Bytes as text with a unit up to TB."""
    power = sum(((size >= 1024**i).cast("int") for i in range(2, 5)), (size >= 1024).cast("int"))
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")])
    text = F.concat(F.format_string("%.2f", size / F.pow(F.lit(1024.0), power)), F.lit(" "), F.element_at(units, power + 1))
    return F.when(size == 0, F.lit("0B")).otherwise(text)


# Bytes per number, per point and per payload in the storage estimate.
BYTES_PER_NUMBER, BYTES_PER_POINT, BYTES_PER_PAYLOAD = 4, 100, 500


def storage_estimate(points: DataFrame, vector_column: str = "embedding") -> DataFrame:
    counted = points.agg(F.count(F.lit(1)).alias("count"), F.max(F.size(vector_column)).alias("vector_size"))
    size = F.col("count") * (F.col("vector_size") * BYTES_PER_NUMBER + BYTES_PER_POINT + BYTES_PER_PAYLOAD)
    return counted.withColumn("estimated_bytes", size).withColumn("estimated_size", readable_size(F.col("estimated_bytes")))


def key_bounds(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(key).alias("keys"))


def progress_report(progress: DataFrame, batch: int = 1000) -> DataFrame:
    """``collection, offset`` rows as a status report; offset -1 marks a finished collection."""
    done = F.col("offset") == -1
    return progress.select(
        "collection",
        F.when(done, "COMPLETED").otherwise("IN PROGRESS").alias("status"),
        F.when(~done, F.col("offset")).alias("last_offset"),
        F.when(~done, F.floor(F.col("offset") / batch)).alias("batches"),
    )


def json_structure(df: DataFrame, column: str, depth: int = 4) -> DataFrame:
    """``key, kind, count``: every key path of the objects in a JSON text column, with each kind of value found there, over all rows.

    Objects are opened level by level, ``depth`` of them; a row leaves one row per key. Texts that are no JSON are left out.
    """
    level = df.select(F.lit("$").alias("key"), F.try_parse_json(column).alias("value")).where("value is not null")
    found = None
    for _ in range(depth):
        # variant_explode also opens arrays, whose entries have no key.
        level = level.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("value").outer()).select(F.col("key").alias("name"), F.col("value").alias("inner")))
        level = level.where("name is not null").select(F.concat_ws(".", "key", "name").alias("key"), F.col("inner").alias("value"))
        kinds = level.groupBy("key", F.regexp_extract(F.schema_of_variant("value"), r"^\w+", 0).alias("kind")).agg(F.count("*").alias("count"))
        found = kinds if found is None else found.unionByName(kinds)
        level = level.where(F.schema_of_variant("value").startswith("OBJECT"))
    return found


def field_structure(df: DataFrame) -> DataFrame:
    """Every nested field with its type; array fields also with their largest length."""
    fields: list[tuple[str, str, Column | None]] = []

    def walk(prefix: str, column: Column, kind: T.DataType) -> None:
        largest = F.max(F.when(column.isNotNull(), F.size(column))) if isinstance(kind, T.ArrayType) else None
        fields.append((prefix, kind.simpleString(), largest))
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(f"{prefix}.{f.name}", column.getField(f.name), f.dataType)

    for f in df.schema:
        walk(f.name, F.col(f.name), f.dataType)
    rows = [
        F.struct(F.lit(n).alias("field"), F.lit(k).alias("type"), (size if size is not None else F.max(F.lit(None).cast("int"))).alias("max_length"))
        for n, k, size in fields
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
