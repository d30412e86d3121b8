"""Exact grouped quantiles that stay distributed when one group is huge.

``percentile``/``median`` keep every distinct value of a group in the memory of one task. Here a
mergeable sketch first finds, per group, a narrow bracket around each wanted rank. A second pass
counts the rows below the bracket and keeps only the values inside it, so that one task orders a
small share of a group and the answer is still the exact, linearly interpolated quantile. Groups
whose brackets would still be large are sketched again, finer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.session import stage

STATS = ("n", "mean", "std", "low", "high")


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    extras: dict[str, Column] | None = None,
    accuracy: int = 1_000,
    max_candidates: int = 5_000_000,
) -> DataFrame:
    """One row per group and measure: ``keys, measure, n, mean, std, low, high, q, *extras``.

    ``q`` is an array holding one exact quantile per entry of ``probs``. ``extras`` are further
    aggregates of the whole group. Rows with a null key are dropped, as are groups whose measure is
    always null.

    A bracket spans ``8 / accuracy`` of a group. The accuracy grows tenfold until that is at most
    ``max_candidates`` rows of the largest group.
    """
    keys, extras = list(keys), extras or {}
    source = df.dropna(subset=keys) if keys else df
    while True:
        # One row per group, read by the second pass and again for the result.
        summary = stage(_summary(source, keys, columns, probs, extras, accuracy), "quantiles")
        largest = summary.agg(F.max(F.array_max(F.transform("stats", lambda s: s["n"])))).first()[0] or 0
        if largest * 8 / accuracy <= max_candidates:
            break
        accuracy *= 10
    edges = summary.select(*keys, F.transform("stats", lambda s: s["edges"]).alias("__edges"))
    values = source.select(*keys, F.array(*[_number(c) for c in columns]).alias("__values"))
    if keys:
        bracketed = values.join(edges, keys)
    else:  # one row with a few numbers per measure
        known = F.array(*[F.array(*[F.lit(float(e)) for e in measure]) for measure in edges.first()[0]])
        bracketed = values.withColumn("__edges", known)

    # One row per value with the edges of its measure. The edges cut the line into cells; a value inside
    # a bracket is a candidate and kept, all others of a cell are only counted.
    placed = bracketed.select(
        *keys, F.posexplode(F.arrays_zip("__values", "__edges")).alias("__m", "__x")
    ).select(*keys, "__m", F.col("__x.__values").alias("__v"), F.col("__x.__edges").alias("__e")).where(F.col("__v").isNotNull())
    value = F.col("__v")
    lows = [F.col("__e")[2 * j] for j in range(len(probs))]
    highs = [F.col("__e")[2 * j + 1] for j in range(len(probs))]
    cell = sum(((value > e).cast("int") for e in highs), F.lit(0)) + sum(((value >= e).cast("int") for e in lows), F.lit(0))
    inside = reduce(lambda a, b: a | b, [(value >= lo) & (value <= hi) for lo, hi in zip(lows, highs)])
    counted = placed.select(*keys, "__m", cell.alias("__cell"), F.when(inside, value).alias("__c")).groupBy(
        *keys, "__m", "__cell", "__c"
    ).agg(F.count(F.lit(1)).alias("__k"))
    long = summary.select(*keys, *extras, F.posexplode("stats").alias("__m", "__s")).select(
        *keys, *extras, "__m", *[F.col(f"__s.{s}").alias(s) for s in STATS]
    ).where("n > 0")
    running = F.sum("__k").over(
        Window.partitionBy(*keys, "__m").orderBy("__cell", "__c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.withColumn("__end", running).join(long.select(*keys, "__m", "n"), [*keys, "__m"])

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("__end")) & (rank >= F.col("__end") - F.col("__k")), F.col("__c")))

    positions = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    picked = ranked.groupBy(*keys, "__m").agg(
        *[at(F.floor(p)).alias(f"__a{j}") for j, p in enumerate(positions)],
        *[at(F.ceil(p)).alias(f"__b{j}") for j, p in enumerate(positions)],
    )

    def quantile(j: int) -> Column:
        a, b = F.col(f"__a{j}"), F.col(f"__b{j}")
        found = a + (b - a) * (positions[j] - F.floor(positions[j]))
        missed = F.raise_error(F.lit("quantile bracket missed its rank; raise accuracy")).cast("double")
        return F.when(a.isNull() | b.isNull(), missed).otherwise(found)

    measure = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__m") + 1)
    return picked.join(long, [*keys, "__m"]).select(
        *keys, measure.alias("measure"), *extras, *STATS, F.array(*[quantile(j) for j in range(len(probs))]).alias("q")
    )


def _number(name: str) -> Column:
    """The value as a double; NaN counts as missing."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def _summary(source: DataFrame, keys: list[str], columns: Sequence[str], probs: Sequence[float], extras: dict[str, Column], accuracy: int) -> DataFrame:
    """Per group: the extras, and for every measure its statistics and the edges of its brackets."""
    margin = 4.0 / accuracy
    marks = [mark for p in probs for mark in (max(p - margin, 0.0), min(p + margin, 1.0))]
    everything = F.array(*[F.lit(float("-inf")), F.lit(float("inf"))] * len(probs))

    def stat(name: str) -> Column:
        value = _number(name)
        # A group of at most ``accuracy`` values keeps them all.
        edges = F.when(F.count(value) > accuracy, F.percentile_approx(value, marks, accuracy)).otherwise(everything)
        return F.struct(
            F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
            F.min(value).alias("low"), F.max(value).alias("high"), edges.alias("edges"),
        )

    return source.groupBy(*keys).agg(
        *[expr.alias(name) for name, expr in extras.items()], F.array(*[stat(c) for c in columns]).alias("stats")
    )
