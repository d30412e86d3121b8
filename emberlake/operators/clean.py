"""Type repair: one aggregate pass decides per column what to do, one projection does it.

With ``strict`` a column is only converted when its content supports it. ``strict=False`` applies the
looser rule in which a telling column name is enough.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.functions import parsing as P
from emberlake.functions.parsing import strip
from emberlake.operators.profile import value_counts
from emberlake.operators.project import string_columns
from emberlake.spec import CollectionSpec

Action = Literal["number", "plain_number", "capacity", "timestamp", "epoch", "boolean", "text", "keep"]
# With more kinds of values than this a column is text; above this share of arrays and objects it stays as it is.
MOST_KINDS, MOST_STRUCTURED = 2, 0.5

# --- Fixed values: words in a column name that hint at its type --------------------------------
NUMERIC_NAME_WORDS = [
    "capacity", "efficiency", "range", "consumption", "economy", "battery", "voltage", "current", "speed", "weight",
    "length", "width", "height", "volume", "area", "price", "cost", "rate", "ratio", "percentage", "score", "rating",
    "index", "factor", "coefficient", "metric", "power", "energy", "wlpt", "nedc", "real", "estimate", "teh", "fuel",
    "co2", "available", "status", "count", "total", "average", "mean", "max", "min", "sum", "difference", "gap",
    "margin",
]
LAST_PASS_NAME_WORDS = [
    "capacity", "efficiency", "range", "consumption", "economy", "battery", "voltage", "current", "speed", "weight",
    "length", "width", "height", "volume", "area", "price", "cost", "rate", "ratio", "percentage", "score", "rating",
    "index", "factor", "coefficient", "metric", "power", "energy", "wlpt", "nedc", "real", "estimate", "teh", "fuel",
    "co2",
]
DATE_NAME_WORDS = [
    "date", "time", "created", "updated", "launch", "release", "from", "to", "start", "end", "modified", "timestamp",
    "available", "published", "expired", "valid", "effective",
]
BOOLEAN_NAME_WORDS = ["status", "active", "enabled", "available", "is_", "has_"]
CATEGORY_NAME_WORDS = [
    "status", "type", "category", "brand", "make", "model", "version", "color", "fuel", "transmission", "drive",
    "body", "segment", "level", "grade", "class", "rating", "tier", "group", "family",
]
DATE_LIKE = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})"
# -----------------------------------------------------------------------------------------------


def _named(column: str, words: list[str]) -> bool:
    return any(w in column.lower() for w in words)


@dataclass(frozen=True)
class ColumnEvidence:
    """Shares measured over all rows of one text column."""

    column: str
    filled: int
    numeric: float
    unit: float
    date: float
    date_parsed: float
    epoch: float
    truth_words: int
    other_words: int
    digits: float
    kinds: int
    structured: float


def evidence_report(df: DataFrame) -> DataFrame:
    """The shares behind every decision, one row per text column, measured over all rows.

    The columns are laid out as ``column, value`` rows and counted by value first, which tasks combine before anything is sent.
    The rules then look at distinct values only, each weighing as many rows as hold it.
    """
    names = string_columns(df)
    value = F.col("value")

    def digits(cleaned: Column) -> Column:
        return cleaned.rlike(r"^(\d+\.?\d*|\.\d+)$") & cleaned.rlike("[1-9]")

    def tests(text: Column) -> list[Column]:
        plain, dated = text.rlike(P.PLAIN_NUMBER), text.rlike(DATE_LIKE)
        word_bit = F.lit(0)
        for i, word in enumerate(P.TRUTH_WORDS):
            word_bit = F.when(text == word, F.lit(1 << i)).otherwise(word_bit)
        return [
            (~text.isin(P.MISSING_WORDS)).alias("meant"), plain.alias("plain"),
            (~plain & text.rlike(P.UNIT_NUMBER)).alias("unit"), dated.alias("date"),
            (dated & P.parsed_timestamp(text).isNotNull()).alias("moment"), text.rlike(r"^\d{9,10}(\.\d+)?$").alias("epoch"),
            word_bit.alias("word_bit"), (F.col("named") & P.let(F.regexp_replace(text, r"[^0-9.]", ""), digits)).alias("digits"),
            P.value_kind(text).alias("kind"),
        ]

    # Only a column with a telling name is judged by its digits.
    named = F.col("column").isin([c for c in names if _named(c, LAST_PASS_NAME_WORDS)])
    counted = df.select(*names).unpivot([], names, "column", "value").where(value.isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.select("column", "n", named.alias("named"), strip(value).alias("text")).select("column", "n", *tests(F.col("text")))

    def number(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    def share(condition: Column) -> Column:
        return F.coalesce(F.try_divide(number(F.col("meant") & condition).cast("double"), number(F.col("meant"))), F.lit(0.0))

    found = rows.groupBy("column").agg(
        number(F.col("meant")).alias("filled"), share(F.col("plain") | F.col("unit")).alias("numeric"), share(F.col("unit")).alias("unit"),
        share(F.col("date")).alias("date"), share(F.col("moment")).alias("date_parsed"), share(F.col("epoch")).alias("epoch"),
        # One bit per known word.
        F.bit_count(F.coalesce(F.bit_or(F.col("word_bit")), F.lit(0))).alias("truth_words"),
        number(F.col("word_bit") == 0).alias("other_words"), share(F.col("digits")).alias("digits"),
        F.count_distinct(F.when(F.col("meant"), F.col("kind"))).cast("int").alias("kinds"), share(F.col("kind").isin("array", "object")).alias("structured"),
    )
    # A column without any value has no rows above; it is reported with nothing in it.
    return _with_empty_columns(found, names)


def _with_empty_columns(found: DataFrame, names: list[str]) -> DataFrame:
    every = found.sparkSession.createDataFrame([(n,) for n in names], "column string")
    return every.join(found, "column", "left").fillna(0)


def numeric_threshold(unit_share: float) -> float:
    return 0.5 if unit_share > 0.3 else 0.6 if unit_share > 0.1 else 0.7


def decide(e: ColumnEvidence, strict: bool = True) -> Action:
    name = e.column.lower()
    if "battery" in name and "capacity" in name:
        return "capacity"
    truthful = _named(name, BOOLEAN_NAME_WORDS) and 0 < e.truth_words <= 5 and e.other_words == 0
    if strict and truthful:
        return "boolean"
    by_name = _named(name, NUMERIC_NAME_WORDS)
    is_id = "id" in name and any(w in name for w in ("object", "mongo", "db"))
    by_content = e.filled > 0 and not is_id and e.numeric > numeric_threshold(e.unit)
    if by_name and (not strict or e.numeric > 0.3):
        return "number"
    dated = _named(name, DATE_NAME_WORDS)
    if strict and dated and e.epoch > 0.7:
        return "epoch"
    if by_content:
        return "number"
    if e.filled > 0 and e.date > 0.3 or (not strict and dated):
        return "timestamp" if e.date_parsed >= 0.3 or e.epoch == 0 else "epoch"
    if truthful:
        return "boolean"
    if _named(name, LAST_PASS_NAME_WORDS) and e.digits > 0.3:
        return "plain_number"
    return "text" if is_mixed(e.kinds, e.structured) and not is_id and "embedding" not in name else "keep"


def is_mixed(kinds: int, structured: float) -> bool:
    return kinds > MOST_KINDS and structured <= MOST_STRUCTURED


HINTED: dict[str, Action] = {
    **dict.fromkeys(("numeric", "float", "int", "number"), "plain_number"),
    **dict.fromkeys(("date", "datetime", "timestamp"), "timestamp"),
    **dict.fromkeys(("boolean", "bool"), "boolean"),
}


def kind_report(df: DataFrame) -> DataFrame:
    """How many kinds of values each variant column holds, and the share of arrays and objects among them, over all rows."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.VariantType)]
    kinds = [F.regexp_extract(F.schema_of_variant(F.col(n)), r"^\w+", 0).alias(n) for n in names]
    counted = df.select(*kinds).unpivot([], names, "column", "kind").where("kind <> 'VOID'").groupBy("column", "kind").agg(F.count("*").alias("n"))
    structured = F.sum(F.when(F.col("kind").isin("ARRAY", "OBJECT"), F.col("n")).otherwise(0))
    return counted.groupBy("column").agg(F.count("*").cast("int").alias("kinds"), (structured / F.sum("n")).alias("structured"))


def cleaning_plan(df: DataFrame, spec: CollectionSpec | None = None, strict: bool = True) -> dict[str, Action]:
    """An action per text column, and per variant column of mixed kinds. Collects one row per column."""
    names = string_columns(df)
    plan: dict[str, Action] = {}
    if any(isinstance(f.dataType, T.VariantType) for f in df.schema):
        plan |= {r["column"]: "text" for r in kind_report(df).collect() if is_mixed(r["kinds"], r["structured"])}
    if not names:
        return plan
    for row in evidence_report(df).collect():
        e = ColumnEvidence(**row.asDict())
        hint = HINTED.get((spec.column_types if spec else {}).get(e.column, "").lower())
        if hint == "boolean" and e.other_words:
            hint = "keep"
        plan[e.column] = hint or decide(e, strict)
    return plan


def converted(column: str, action: Action) -> Column:
    value = F.col(column)
    return {
        "number": P.smart_number,
        "plain_number": lambda v: P.plain_number(strip(v)),
        "capacity": P.capacity_number,
        "timestamp": P.parsed_timestamp,
        "epoch": P.epoch_timestamp,
        "boolean": P.truth_value,
        "text": lambda v: v.cast("string"),
        "keep": lambda v: v,
    }[action](value)


def apply_plan(df: DataFrame, plan: dict[str, Action]) -> DataFrame:
    changes = {c: converted(c, a) for c, a in plan.items() if a != "keep"}
    return df.withColumns(changes) if changes else df


def auto_clean(df: DataFrame, spec: CollectionSpec | None = None, strict: bool = True) -> DataFrame:
    return apply_plan(df, cleaning_plan(df, spec, strict))


def apply_hints(df: DataFrame, hints: dict[str, str]) -> DataFrame:
    """Only the declared types; a bad value becomes null, unknown truth words stay undecided (null)."""
    actions = {c: HINTED[t.lower()] for c, t in hints.items() if c in df.columns and t.lower() in HINTED}
    return apply_plan(df, {c: a for c, a in actions.items() if isinstance(df.schema[c].dataType, T.StringType)})


def category_report(df: DataFrame) -> DataFrame:
    """Which text columns look like categories, by distinct share and by the look of their values."""
    names = string_columns(df)
    value = F.col("value")
    looks = (
        (F.length(strip(value)) < 50)
        & ~F.regexp_replace(strip(value), "[.-]", "").rlike(r"^\d+$")
        & ~strip(value).isin("", "N/A", "NA", "None")
    )
    counted = value_counts(df, names).groupBy("column").agg(
        F.sum("count").alias("rows"), F.count("value").alias("distinct"),
        F.try_divide(F.sum(F.when(looks, F.col("count"))).cast("double"), F.sum(F.when(value.isNotNull(), F.col("count")))).alias("looks"),
    )
    limits = F.lit(0.1)
    for name in names:
        if _named(name, CATEGORY_NAME_WORDS):
            limits = F.when(F.col("column") == name, F.lit(0.3)).otherwise(limits)
        elif "id" in name.lower():
            limits = F.when((F.col("column") == name) & (F.col("distinct") < 100), F.lit(0.5)).otherwise(limits)
    ratio = F.col("distinct") / F.col("rows")
    return counted.select(
        "column", "distinct", ratio.alias("ratio"),
        ((ratio < limits) & (F.col("distinct") > 0) & (F.coalesce("looks", F.lit(0.0)) > 0.7)).alias("is_category"),
    )
