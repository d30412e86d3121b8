"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` gives the same rows and column names on the same tables."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 4, keep: str | None = None) -> DataFrame:
    """All doubles rounded, counts as long, dates and arrays as text: the form in which results are compared.

    Columns whose name starts with ``keep`` stay as they are.
    """
    changes = {}
    for f in df.schema:
        if keep and f.name.startswith(keep):
            continue
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            changes[f.name] = F.round(F.col(f.name).cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            changes[f.name] = F.col(f.name).cast("long")
        elif isinstance(f.dataType, T.DateType):
            changes[f.name] = F.date_format(f.name, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            changes[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            changes[f.name] = F.array_join(F.col(f.name).cast("array<string>"), ";")
    return df.withColumns(changes) if changes else df


def _word_sql(start: str) -> str:
    """Four bytes from the hex text ``h``, lowest first, as a number."""
    return "(" + " + ".join(f"coalesce(TRY_CAST('0x' || nullif(substr(h, {start} + {2 * i + 1}, 2), '') AS HUGEINT), 0) * {256**i}" for i in range(4)) + ")"


def _mixed_sql(k: str) -> str:
    """The first mixing of MurmurHash3 (32 bits)."""
    k = f"({k} * 3432918353) % 4294967296"
    return f"((({k}) * 32768 % 4294967296 + ({k}) // 131072) * 461845907) % 4294967296"


def token_slots_sql(source: str, key: str, text: str, size: int) -> str:
    """CTEs ending in ``slots (key, slot, n)``: how many tokens of each text fall into each of ``size`` slots by MurmurHash3 with
    seed 42, which the default encoder uses, written out in SQL."""
    turned = "(xor(a::UBIGINT, b::UBIGINT)::HUGEINT * 8192 % 4294967296 + xor(a::UBIGINT, b::UBIGINT)::HUGEINT // 524288)"
    return f"""
tok AS (SELECT {key} AS key, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM {source}),
hexed AS (SELECT t, hex(encode(t)) AS h, octet_length(encode(t)) AS len FROM (SELECT DISTINCT t FROM tok)),
body AS (SELECT t, h, len, list_reduce(list_concat([42::HUGEINT], list_transform(range(len // 4), lambda i: {_mixed_sql(_word_sql("8 * i"))})),
  lambda a, b: ({turned} * 5 + 3864292196) % 4294967296) AS x FROM hexed),
tail AS (SELECT t, xor(xor(x::UBIGINT, (CASE WHEN len % 4 = 0 THEN 0 ELSE {_mixed_sql(_word_sql("8 * (len // 4)"))} END)::UBIGINT), len::UBIGINT)::HUGEINT AS x FROM body),
f1 AS (SELECT t, xor(x::UBIGINT, (x // 65536)::UBIGINT)::HUGEINT * 2246822507 % 4294967296 AS x FROM tail),
f2 AS (SELECT t, xor(x::UBIGINT, (x // 8192)::UBIGINT)::HUGEINT * 3266489909 % 4294967296 AS x FROM f1),
f3 AS (SELECT t, xor(x::UBIGINT, (x // 65536)::UBIGINT)::HUGEINT AS x FROM f2),
slots AS (SELECT key, CAST(((CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END) % {size} + {size}) % {size} AS BIGINT) AS slot, count(*) AS n FROM tok JOIN f3 USING (t) GROUP BY 1, 2)"""
