"""Joins, tagged unions and duplicates.

No join here forces a broadcast: a side below ``spark.sql.autoBroadcastJoinThreshold`` is broadcast
by Spark after it has measured it, a larger one is shuffled, and AQE splits skewed partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.operators.project import composite_id


def raw_with_vectors(
    raw: DataFrame, vectors: DataFrame, keys: Sequence[str], id_columns: Sequence[str],
    vector_column: str = "embedding", id_name: str = "unique_id",
) -> DataFrame:
    """Raw rows joined to their vectors on all keys, with a composite id."""
    joined = raw.join(vectors.select(*keys, vector_column), list(keys), "inner")
    return joined.withColumn(id_name, composite_id(id_columns))


def link_join(main: DataFrame, link: DataFrame, main_key: str, link_key: str, how: str = "left") -> DataFrame:
    """Main rows with the link table's columns, each named ``<column>_link``."""
    renamed = link.withColumnsRenamed({c: f"{c}_link" for c in link.columns})
    return main.join(renamed, F.col(main_key) == F.col(f"{link_key}_link"), how)


def link_join_counts(main: DataFrame, link: DataFrame, main_key: str, link_key: str) -> DataFrame:
    """Main rows, joined rows, and main rows with and without a link, as one row.

    The link keys are counted first, so a key with many link rows does not multiply anything.
    """
    per_key = link.where(F.col(link_key).isNotNull()).groupBy(F.col(link_key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    main_keys = main.groupBy(F.col(main_key).alias("__m")).agg(F.count(F.lit(1)).alias("__r"))
    matched = main_keys.join(per_key, F.col("__m") == F.col("__k"), "left")
    hit = F.col("__n").isNotNull()
    return matched.agg(
        F.sum("__r").alias("total_rows"),
        F.coalesce(F.sum(F.when(hit, F.col("__r"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(~hit, F.col("__r"))), F.lit(0)).alias("unmatched"),
        F.sum(F.col("__r") * F.coalesce("__n", F.lit(1))).alias("joined_rows"),
    )


@dataclass(frozen=True)
class Relationship:
    left_table: str
    right_table: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]


def suffixed_join(left: DataFrame, right: DataFrame, rel: Relationship) -> DataFrame:
    """Inner join; columns present on both sides get their table's name, a key named alike stays once."""
    shared_keys = {l for l, r in zip(rel.left_keys, rel.right_keys) if l == r}
    clash = (set(left.columns) & set(right.columns)) - shared_keys
    left_names = {c: f"{c}_{rel.left_table}" for c in clash}
    right_names = {c: f"{c}_{rel.right_table}" for c in clash} | {k: f"__right_{k}" for k in shared_keys}
    a, b = left.withColumnsRenamed(left_names), right.withColumnsRenamed(right_names)
    condition = [
        a[left_names.get(l, l)] == b[right_names.get(r, r)] for l, r in zip(rel.left_keys, rel.right_keys)
    ]
    return a.join(b, condition, "inner").drop(*[f"__right_{k}" for k in shared_keys])


def join_related(frames: Mapping[str, DataFrame], relationships: Sequence[Relationship]) -> dict[str, DataFrame]:
    """Apply each relationship; tables that are missing, or lack a key, stay on their own."""
    result: dict[str, DataFrame] = {}
    used: set[str] = set()
    for rel in relationships:
        if rel.left_table not in frames or rel.right_table not in frames:
            continue
        left, right = frames[rel.left_table], frames[rel.right_table]
        complete = set(rel.left_keys) <= set(left.columns) and set(rel.right_keys) <= set(right.columns)
        if complete:
            result[f"{rel.left_table}_{rel.right_table}_joined"] = suffixed_join(left, right, rel)
        else:
            result |= {t: frames[t] for t in (rel.left_table, rel.right_table) if t not in used}
        used |= {rel.left_table, rel.right_table}
    return result | {name: df for name, df in frames.items() if name not in used}


def tagged_union(frames: Mapping[str, DataFrame], tag: str = "_source_table") -> DataFrame:
    """Stack tables with their names; a column that several tables have is kept once per table."""
    times = Counter(c for df in frames.values() for c in df.columns)
    stacked = None
    for name, df in frames.items():
        renamed = df.withColumnsRenamed({c: f"{c}_{name}" for c in df.columns if times[c] > 1})
        renamed = renamed.withColumn(tag, F.lit(name))
        stacked = renamed if stacked is None else stacked.unionByName(renamed, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("no tables to combine")
    return stacked


def combine_tables(frames: Mapping[str, DataFrame], relationships: Sequence[Relationship] = ()) -> DataFrame:
    parts = join_related(frames, relationships) if relationships else dict(frames)
    return next(iter(parts.values())) if len(parts) == 1 else tagged_union(parts)


def unused_rows(df: DataFrame, used: DataFrame, id_column: str) -> DataFrame:
    """Rows whose id is not among the used ones."""
    return df.join(used.select(id_column), id_column, "left_anti")


def all_used(old: DataFrame, new: DataFrame, id_column: str) -> DataFrame:
    return old.select(id_column).union(new.select(id_column)).distinct()


def without_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def _hashable(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Columns as grouping keys; map columns, which cannot be grouped, as sorted entries."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return [
        F.array_sort(F.map_entries(c)).alias(c) if kinds[c] == "map" else F.col(c) for c in columns
    ]


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each distinct row, or of each distinct key."""
    groups = df.groupBy(*_hashable(df, columns or df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"),
    )


def duplicate_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("counts")).where("counts > 1")


def refresh_from(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Old rows with the given columns replaced where a new row exists; other rows unchanged."""
    fresh = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = old.join(fresh, list(keys), "left")
    merged = joined.withColumns({c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) for c in columns})
    return merged.select(*old.columns)


def describe_fields(df: DataFrame, descriptions: Mapping[str, str], name: str = "_field_descriptions") -> DataFrame:
    """A map from each documented, non-null field of the row to its description."""
    known = [(c, descriptions[c]) for c in df.columns if c in descriptions]
    entries = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.lit(text).alias("value")))
        for c, text in known
    ]))
    return df.withColumn(name, F.map_from_entries(entries))


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows per key. Spark cuts each task's rows before the shuffle, so a hot key
    sends at most ``limit`` rows per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")
