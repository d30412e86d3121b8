"""Row filters. All are plain predicates, so scans can push them down."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.project import string_columns
from emberlake.spec import TableSpec


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def in_date_range(df: DataFrame, spec: TableSpec, start: Any, end: Any) -> DataFrame:
    """Inclusive range on the table's date column; no date column, no filter."""
    if not spec.date_column or spec.date_column not in df.columns:
        return df
    return df.where(F.col(spec.date_column).between(F.lit(start), F.lit(end)))


def matching_keywords(df: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Rows where any string column contains any keyword, in either case; no keywords, all rows."""
    names = string_columns(df)
    if not keywords or not names:
        return df
    pattern = "(?i)" + "|".join(_quoted(k) for k in keywords)
    return df.where(any_of([F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in names]))


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def with_keys(df: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose key tuple occurs in ``keys``. AQE broadcasts the keys when they turn out small."""
    wanted = keys.select(*columns).dropna().distinct()
    return df.join(wanted, list(columns), "left_semi")


def array_has(column: str, value: str) -> Column:
    return F.coalesce(F.array_contains(F.col(column), F.lit(value)), F.lit(False))


def array_has_prefix(column: str, prefixes: Sequence[str]) -> Column:
    pattern = "(?i)^(" + "|".join(_quoted(p) for p in prefixes) + ")"
    return F.coalesce(F.exists(F.col(column), lambda x: x.rlike(pattern)), F.lit(False))


def array_has_part(column: str, parts: Sequence[str]) -> Column:
    return F.coalesce(
        F.exists(F.col(column), lambda x: any_of([F.upper(x).contains(p.upper()) for p in parts])), F.lit(False)
    )


def number_in_question(question: Column) -> Column:
    """The first run of digits, null without one; used as the id when nothing else was found."""
    found = F.regexp_extract(question, r"(\d+)", 1)
    return F.when(found != "", found)


def matching_regex(df: DataFrame, columns: Sequence[str], pattern: str) -> DataFrame:
    return df.where(any_of([F.coalesce(F.col(c).rlike("(?i)" + pattern), F.lit(False)) for c in columns]))


def matching_values(df: DataFrame, wanted: Mapping[str, Any]) -> DataFrame:
    """Equality filter over several columns; a list means any of its values."""
    if not wanted:
        return df
    return df.where(all_of([
        F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v)
        for k, v in wanted.items()
    ]))


def counts_or_fallback(df: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Value counts of rows that satisfy two ``contains`` conditions; if there are none, counts of the
    first condition's column over the rows that satisfy the first one alone.

    One pass: both candidate counts are built together, and the one-row flag picks the branch.
    """
    one = F.coalesce(F.lower(first[0]).contains(first[1].lower()), F.lit(False))
    two = F.coalesce(F.lower(second[0]).contains(second[1].lower()), F.lit(False))
    hits = df.where(one).select(
        F.col(first[0]).cast("string").alias("fallback"),
        F.when(two, F.col(second[0]).cast("string")).alias("main"),
        two.alias("both"),
    )
    counted = hits.groupBy("both", F.when(F.col("both"), F.col("main")).alias("main"), "fallback").agg(F.count(F.lit(1)).alias("n"))
    any_both = counted.agg(F.coalesce(F.bool_or("both"), F.lit(False)).alias("x")).scalar()
    chosen = counted.where((F.col("both") & any_both) | ~any_both)
    return chosen.groupBy(F.when(any_both, F.col("main")).otherwise(F.col("fallback")).alias("value")).agg(
        F.sum("n").alias("count")
    ).where(F.col("value").isNotNull())


def key_range(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows with ``low <= key < high``."""
    return df.where((F.col(key) >= low) & (F.col(key) < high))


def page(df: DataFrame, order: Sequence[str], number: int, size: int = 20) -> DataFrame:
    """Page ``number`` (from 0) of the ordered rows; for deep pages use ``page_after``."""
    return df.orderBy(*order).offset(number * size).limit(size)


def page_after(df: DataFrame, key: str, last: Any, size: int = 20) -> DataFrame:
    """The next page after a unique key: a pushed-down filter instead of re-sorting all pages before."""
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(size)


def newer_than(df: DataFrame, column: str, as_of: Any, days: int) -> DataFrame:
    """Retention: rows of the last ``days`` days before ``as_of``."""
    return df.where(F.col(column) > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def removed_count(df: DataFrame, column: str, as_of: Any, days: int) -> DataFrame:
    """How many rows the retention rule removes and keeps."""
    old = F.col(column) <= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))


def active_patterns(patterns: DataFrame, collection: str) -> DataFrame:
    return patterns.where((F.col("collection_name") == collection) & F.col("is_active")).orderBy(
        F.desc("confidence_score"), "question_pattern"
    )


def scored_at_least(df: DataFrame, threshold: float | None, score: str = "score") -> DataFrame:
    return df if threshold is None else df.where(F.col(score) >= threshold)
