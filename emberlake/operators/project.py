"""Projections, casts and derived columns. Nothing here runs a job: the schema is enough."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.spec import CollectionSpec, TableSpec


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def coerce_declared(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Declared numeric and date columns; a bad value becomes null, an absent column is ignored."""
    changes: dict[str, Column] = {}
    for name in spec.numeric:
        if name in df.columns:
            changes[name] = F.col(name).try_cast("double")
    for name in spec.datetime:
        if name in df.columns:
            changes[name] = F.col(name).try_cast("timestamp")
    for name in spec.categorical:
        if name in df.columns:
            changes[name] = F.col(name).cast("string")
    return df.withColumns(changes) if changes else df


def cast_columns(df: DataFrame, to_double: Sequence[str] = (), to_long: Sequence[str] = ()) -> DataFrame:
    changes = {c: F.col(c).try_cast("double") for c in to_double if c in df.columns}
    # A text such as "25.2" counts as 25, like any number cast to a long.
    changes |= {
        c: F.coalesce(F.col(c).try_cast("bigint"), F.col(c).try_cast("decimal(38,10)").try_cast("bigint"))
        for c in to_long if c in df.columns
    }
    return df.withColumns(changes) if changes else df


def find_column(df: DataFrame, name: str) -> str | None:
    """The column of that name in either case."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def with_year_month(df: DataFrame, date_column: str, year: str = "lodgement_year", month: str = "lodgement_month") -> DataFrame:
    name = find_column(df, date_column)
    if name is None:
        return df
    moment = F.col(name) if not isinstance(df.schema[name].dataType, T.StringType) else F.col(name).try_cast("timestamp")
    return df.withColumns({year: F.year(moment), month: F.month(moment)})


def with_month_start(df: DataFrame, year: str, month: str, name: str = "date") -> DataFrame:
    return df.withColumn(name, F.make_date(F.col(year), F.col(month), F.lit(1)))


def with_year_month_label(df: DataFrame, year: str, month: str, name: str = "year_month") -> DataFrame:
    return df.withColumn(name, F.format_string("%04d-%02d", F.col(year), F.col(month)))


def keep_configured(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The configured columns that exist; all columns when none does."""
    present = [c for c in wanted if c in df.columns]
    return df.select(*present) if present else df


def keep_essential(df: DataFrame, spec: CollectionSpec) -> DataFrame:
    """Essential columns, or all when none of them exists; without a list, drop the excluded ones."""
    if spec.essential_columns:
        present = [c for c in spec.essential_columns if c in df.columns]
        return df.select(*(present or df.columns))
    allowed = [c for c in df.columns if c not in spec.exclude_columns]
    return df.select(*allowed) if allowed else df


def document_projection(df: DataFrame, spec: CollectionSpec) -> DataFrame:
    """Essential minus excluded columns; the usual connection fields when no list is given."""
    wanted = spec.essential_columns or ("UPRN", "ADDRESS", "POSTCODE", "EMSN", "MPAN", "MPRN", "apiStatus")
    hidden = set(spec.exclude_columns) | ({"_id"} - set(spec.essential_columns))
    return df.select(*[c for c in wanted if c in df.columns and c not in hidden])


def truncate_text(df: DataFrame, limits: Mapping[str, int] | None = None, default: int = 50) -> DataFrame:
    """Cut long strings and mark the cut; shorter strings and nulls stay as they are."""
    limits = limits or {}
    changes = {}
    for name in string_columns(df):
        size = min(limits.get(name, default), default)
        changes[name] = F.when(F.length(name) > size, F.concat(F.left(F.col(name), F.lit(size)), F.lit("..."))).otherwise(F.col(name))
    return df.withColumns(changes) if changes else df


def rename_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in aliases.items() if old in df.columns})


def row_text(df: DataFrame, exclude: Sequence[str] = (), name: str = "row_text") -> DataFrame:
    """All other columns as text joined by ``" | "``; a null prints as ``None``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in df.columns if c not in exclude]
    return df.withColumn(name, F.concat_ws(" | ", *parts))


# Labels of a building row's text, in order.
BUILDING_LABELS = {
    "uprn_link": "UPRN", "upn_link": "UPN", "premise_id": "Premise ID", "premise_type": "Property type",
    "bedroom_count": "Bedrooms", "reception_room_count": "Reception rooms", "habitable_rooms": "Habitable rooms",
}
ADDRESS_PARTS = ("building_name", "building_number", "street_name", "locality", "town", "postcode")


def labelled_text(
    df: DataFrame,
    labels: Mapping[str, str] = BUILDING_LABELS,
    address: Sequence[str] = ADDRESS_PARTS,
    tail: Mapping[str, str] | None = None,
    name: str = "text",
) -> DataFrame:
    """``label: value`` parts joined by ``" | "``, null parts left out, address fields joined by spaces."""
    def part(column: str, label: str) -> Column:
        return F.concat(F.lit(f"{label}: "), F.col(column).cast("string"))

    tail = {"energy_rating": "Energy rating"} if tail is None else tail
    parts = [part(c, label) for c, label in labels.items() if c in df.columns]
    present = [F.col(c).cast("string") for c in address if c in df.columns]
    if present:
        joined = F.concat_ws(" ", *present)
        known = F.coalesce(*present).isNotNull()
        parts.append(F.when(known, F.concat(F.lit("Address: "), joined)))
    parts += [part(c, label) for c, label in tail.items() if c in df.columns]
    return df.withColumn(name, F.concat_ws(" | ", *parts))


def composite_id(columns: Sequence[str], separator: str = "_") -> Column:
    """Key columns as text joined by the separator; a null part becomes empty, its place is kept."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def row_hash(df: DataFrame) -> Column:
    """A stable id of the whole row, for tables without key columns."""
    return F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)


def stable_id(df: DataFrame, id_columns: Sequence[str], separator: str = "-") -> Column:
    if id_columns and all(c in df.columns for c in id_columns):
        return composite_id(id_columns, separator)
    return row_hash(df)


def payload(df: DataFrame, vector_column: str = "embedding") -> Column:
    return F.struct(*[c for c in df.columns if c != vector_column])


def json_safe(column: Column, kind: T.DataType) -> Column:
    """The same value with everything JSON cannot hold replaced: bytes and NaN by null, dates by text."""
    if isinstance(kind, T.BinaryType):
        return F.lit(None).cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: json_safe(v, kind.valueType))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[json_safe(column.getField(f.name), f.dataType).alias(f.name) for f in kind])
        return F.when(column.isNotNull(), inner)
    if isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType)):
        return column
    return column.cast("string")


def json_payload(df: DataFrame, exclude: Sequence[str] = ("embedding",)) -> Column:
    parts = [json_safe(F.col(f.name), f.dataType).alias(f.name) for f in df.schema if f.name not in exclude]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def unpivot_pair(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "Type", value: str = "Consumption") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def chat_text(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("<|user|>\n"), question, F.lit("\n<|assistant|>\n"), answer)


def format_moment(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def shortened(column: Column, size: int = 100) -> Column:
    return F.left(column, F.lit(size))


def percent_ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole``, null when the whole is zero or null."""
    return F.round(F.try_divide(part, whole) * 100, digits)
