"""Column expressions that turn untidy text into typed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that stands for "no value", date layouts, unit spellings, truth words.
MISSING_WORDS = ["", "N/A", "NA", "None", "Unknown", "TBD", "n/a", "na", "NULL", "null"]
CAPACITY_MISSING_WORDS = MISSING_WORDS + [
    "nan", "NaN", "NAN", "inf", "Inf", "INF", "-inf", "-Inf", "-INF",
]
ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2})?$"
MONTH_DAY_YEAR, DAY_MONTH_YEAR = r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$"
UNIT_NUMBER = r"(?i)^(\d+\.?\d*)\s*(?:kwh/100km?|l/100km?|kwh|kw|wh|w|kah|mah|ah|km|mi|mpg)$"
TRUTH_WORDS = {
    "Yes": True, "No": False, "True": True, "False": False, "1": True, "0": False,
    "Active": True, "Inactive": False, "Available": True, "Unavailable": False,
}
OBJECT_ID = r"^[0-9a-fA-F]{24}$"
PLAIN_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def strip(column: Column | str) -> Column:
    """Text without white space at its ends; ``trim`` alone removes only spaces.

    Most texts have none, so only those whose first or last character is white space are rewritten.
    """
    text = F.col(column) if isinstance(column, str) else column
    space = [" ", "\t", "\n", "\r", "\x0b", "\x0c"]
    edges = F.substring(text, 1, 1).isin(space) | F.substring(text, -1, 1).isin(space)
    return F.when(edges, F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A column that an expression mentions several times is otherwise copied into each place, and
    branches of a ``when`` do not share it.
    """
    return F.transform(F.array(value), body)[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")


def plain_number(text: Column) -> Column:
    """A number without unit, sign and exponent allowed; words such as ``inf`` are not numbers."""
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def _number_of(text: Column) -> Column:
    def with_parts(parts: Column) -> Column:
        middle = (_digits(parts[0]) + _digits(parts[1])) / 2
        return (
            F.when((F.size(parts) == 2) & parts[0].rlike(r"\d") & parts[1].rlike(r"\d"), middle)
            .when(text.rlike(UNIT_NUMBER), F.regexp_extract(text, UNIT_NUMBER, 1).try_cast("double"))
        )

    parts = F.when(text.contains("-"), F.split(text, "-")).otherwise(F.split(text, " to "))
    return (
        F.when(text.isin(MISSING_WORDS), F.lit(None).cast("double"))
        .when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
        .when(text.contains("%"), strip(F.replace(text, F.lit("%"), F.lit(""))).try_cast("double") / 100)
        .when(~text.rlike(r"\d"), F.lit(None).cast("double"))
        .otherwise(F.coalesce(let(parts, with_parts), _digits(text)))
    )


def smart_number(column: Column) -> Column:
    """Missing words, percentages, ranges and units to a double.

    A plain signed or scientific number is read as it stands; only other text goes through the
    range, unit and digits-only rules.
    """
    return let(strip(column), _number_of)


def capacity_number(column: Column) -> Column:
    """``smart_number`` for capacity columns: text after an ellipsis is cut, ``1.2.3`` reads as 1.2."""
    def cut(text: Column) -> Column:
        head = F.substring_index(text, "...", 1)
        return F.when(text.contains("...") & head.rlike(r"\d"), F.regexp_replace(head, r"[^0-9.]", "")).otherwise(text)

    def two_parts(text: Column) -> Column:
        first = F.regexp_extract(F.regexp_replace(text, r"[^0-9.]", ""), r"^(\d*\.\d*)\.", 1)
        return F.when(first.rlike(r"\d"), first.try_cast("double"))

    def read(text: Column) -> Column:
        return F.when(~text.isin(CAPACITY_MISSING_WORDS), let(cut(text), lambda t: F.coalesce(_number_of(t), two_parts(t))))

    return let(strip(column), read)


def numeric_like(column: Column) -> Column:
    """True when the text is a number, with or without one of the known units."""
    return let(strip(column), lambda text: text.rlike(PLAIN_NUMBER) | text.rlike(UNIT_NUMBER))


def parsed_timestamp(column: Column) -> Column:
    """The timestamp of a text in one of the known layouts; anything else gives null.

    Texts are brought into ISO order and cast, which is far cheaper than a formatter per layout.
    """
    def part(text: Column, start: int, size: int) -> Column:
        return F.substring(text, start, size)

    def read(text: Column) -> Column:
        return (
            F.when(text.rlike(ISO_MOMENT), text.try_cast("timestamp"))
            .when(text.rlike(MONTH_DAY_YEAR), F.concat_ws("-", part(text, 7, 4), part(text, 1, 2), part(text, 4, 2)).try_cast("timestamp"))
            .when(text.rlike(DAY_MONTH_YEAR), F.concat_ws("-", part(text, 7, 4), part(text, 4, 2), part(text, 1, 2)).try_cast("timestamp"))
        )

    return let(strip(column), read)


def epoch_timestamp(column: Column) -> Column:
    return F.timestamp_seconds(strip(column).try_cast("double"))


def truth_value(column: Column) -> Column:
    pairs = [item for word, value in TRUTH_WORDS.items() for item in (F.lit(word), F.lit(value))]
    return F.try_element_at(F.create_map(*pairs), column)


def value_kind(column: Column) -> Column:
    """The kind of value a text looks like."""
    def kind(text: Column) -> Column:
        return (
            F.when(text.rlike(r"^[+-]?\d+$"), "integer")
            .when(text.rlike(PLAIN_NUMBER), "number")
            .when(text.isin("True", "False", "true", "false"), "boolean")
            .when(text.startswith("[") & text.endswith("]"), "array")
            .when(text.startswith("{") & text.endswith("}"), "object")
            .otherwise("text")
        )

    return let(strip(column), kind)


def json_like(column: Column) -> Column:
    return let(strip(column), lambda t: (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]")))
