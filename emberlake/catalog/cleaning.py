"""CLN, NST and GEO queries."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.catalog.base import query, rounded
from emberlake.functions import parsing as PA
from emberlake.operators import clean as C
from emberlake.operators import geo as G
from emberlake.operators import nested as N
from emberlake.plans.stand_ins import CONNECTIONS_SQL, DIRTY_SQL, connections, dirty_readings
from emberlake.session import fresh_path
from emberlake.sources.readers import read_folder, table
from emberlake.sources.writers import overwrite

_DIGITS = "TRY_CAST(regexp_replace({x}, '[^0-9.]', '', 'g') AS DOUBLE)"
_SMART = f"""CASE WHEN trim(reading) IN ('', 'N/A', 'NA', 'None', 'Unknown', 'TBD', 'n/a', 'na', 'NULL', 'null') THEN NULL
  WHEN regexp_matches(trim(reading), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST(trim(reading) AS DOUBLE)
  WHEN contains(reading, '%') THEN TRY_CAST(trim(replace(reading, '%', '')) AS DOUBLE) / 100
  WHEN contains(reading, '-') AND len(string_split(reading, '-')) = 2
    THEN ({_DIGITS.format(x="string_split(reading, '-')[1]")} + {_DIGITS.format(x="string_split(reading, '-')[2]")}) / 2
  WHEN contains(reading, ' to ') AND len(string_split(reading, ' to ')) = 2
    THEN ({_DIGITS.format(x="string_split(reading, ' to ')[1]")} + {_DIGITS.format(x="string_split(reading, ' to ')[2]")}) / 2
  ELSE {_DIGITS.format(x="reading")} END"""


@query("cln01_schema_hints", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, TRY_CAST(reading AS DOUBLE) AS reading,
  strftime(TRY_CAST(ship_text AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ship_text, is_discounted = 'Yes' AS is_discounted FROM {DIRTY_SQL} d""")
def _(spark, sf):
    hints = {"reading": "numeric", "ship_text": "date", "is_discounted": "boolean"}
    return rounded(C.apply_hints(dirty_readings(spark, sf), hints).select("l_orderkey", "l_linenumber", "reading", "ship_text", "is_discounted"))


@query("cln02_evidence", f"""
WITH d AS (SELECT *, trim(reading) IN ('N/A') AS no_value FROM {DIRTY_SQL} x)
SELECT 'reading' AS "column", count(*) FILTER (NOT no_value) AS filled,
  round(count(*) FILTER (l_linenumber IN (1, 6)) * 1.0 / count(*) FILTER (NOT no_value), 4) AS numeric,
  round(count(*) FILTER (l_linenumber = 1) * 1.0 / count(*) FILTER (NOT no_value), 4) AS unit FROM d
UNION ALL SELECT 'ship_text', count(*), 0, 0 FROM d
UNION ALL SELECT 'is_discounted', count(*), 0, 0 FROM d
UNION ALL SELECT 'return_type', count(*), 0, 0 FROM d
UNION ALL SELECT 'battery_capacity', count(*), round(count(*) FILTER (l_linenumber <= 4) * 1.0 / count(*), 4), 0 FROM d""")
def _(spark, sf):
    return rounded(C.evidence_report(dirty_readings(spark, sf)).select("column", "filled", "numeric", "unit"))


@query("cln03_smart_number", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round({_SMART}, 4) AS number FROM {DIRTY_SQL} d")
def _(spark, sf):
    return rounded(dirty_readings(spark, sf).select("l_orderkey", "l_linenumber", PA.smart_number(F.col("reading")).alias("number")))


@query("cln04_dates", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, strftime(TRY_CAST(ship_text AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS moment FROM {DIRTY_SQL} d")
def _(spark, sf):
    return rounded(dirty_readings(spark, sf).select("l_orderkey", "l_linenumber", PA.parsed_timestamp(F.col("ship_text")).alias("moment")))


@query("cln04_epoch", "SELECT event_id, strftime(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS moment FROM events")
def _(spark, sf):
    text = (F.col("event_id") + 1700000000).cast("string")
    return rounded(table(spark, sf, "events").select("event_id", PA.epoch_timestamp(text).alias("moment")))


@query("cln05_booleans", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, is_discounted = 'Yes' AS flag FROM {DIRTY_SQL} d")
def _(spark, sf):
    return rounded(dirty_readings(spark, sf).select("l_orderkey", "l_linenumber", PA.truth_value(F.col("is_discounted")).alias("flag")))


@query("cln06_categories", """
SELECT 'p_name' AS "column", count(DISTINCT p_name) AS "distinct", round(count(DISTINCT p_name) * 1.0 / count(*), 6) AS ratio, count(DISTINCT p_name) * 1.0 / count(*) < 0.1 AS is_category FROM part
UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), round(count(DISTINCT p_brand) * 1.0 / count(*), 6), count(DISTINCT p_brand) * 1.0 / count(*) < 0.3 FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type), round(count(DISTINCT p_type) * 1.0 / count(*), 6), count(DISTINCT p_type) * 1.0 / count(*) < 0.3 FROM part""")
def _(spark, sf):
    return rounded(C.category_report(table(spark, sf, "part")), 6)


@query("cln07_value_kinds", f"""
SELECT CASE WHEN regexp_matches(trim(reading), '^[+-]?\\d+$') THEN 'integer' ELSE 'text' END AS kind, count(*) AS count FROM {DIRTY_SQL} d GROUP BY 1""")
def _(spark, sf):
    return dirty_readings(spark, sf).groupBy(PA.value_kind(F.col("reading")).alias("kind")).agg(F.count(F.lit(1)).alias("count"))


# Values of four kinds: numbers, texts, truth values, objects.
_MIXED = """CASE event_type WHEN 'click' THEN CAST(event_id AS STRING) WHEN 'error' THEN 'true' WHEN 'view' THEN props ELSE '"' || event_type || '"' END"""


@query("cln07_mixed_kinds", f"""
SELECT event_id, CASE event_type WHEN 'click' THEN CAST(event_id AS STRING) WHEN 'error' THEN 'true' WHEN 'view' THEN replace(props, ': ', ':') ELSE event_type END AS mixed,
  'string' AS kind_of_mixed, 'variant' AS kind_of_numbers, CAST(event_id AS STRING) AS numbers FROM events""")
def _(spark, sf):
    parsed = table(spark, sf, "events").select("event_id", F.parse_json(F.expr(_MIXED)).alias("mixed"), F.parse_json(F.col("event_id").cast("string")).alias("numbers"))
    cleaned = C.auto_clean(parsed)
    kinds = dict(cleaned.dtypes)
    return cleaned.select("event_id", "mixed", F.lit(kinds["mixed"]).alias("kind_of_mixed"), F.lit(kinds["numbers"]).alias("kind_of_numbers"), F.col("numbers").cast("string").alias("numbers"))


@query("cln07_kind_report", f"SELECT 'mixed' AS \"column\", 4 AS kinds, round(count(*) FILTER (event_type = 'view') * 1.0 / count(*), 4) AS structured FROM events")
def _(spark, sf):
    return rounded(C.kind_report(table(spark, sf, "events").select(F.parse_json(F.expr(_MIXED)).alias("mixed"))))


@query("cln08_capacity", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(regexp_extract(battery_capacity, '^(\\d+\\.\\d+)', 1) AS DOUBLE) AS capacity FROM {DIRTY_SQL} d""")
def _(spark, sf):
    return rounded(dirty_readings(spark, sf).select("l_orderkey", "l_linenumber", PA.capacity_number(F.col("battery_capacity")).alias("capacity")))


@query("cln09_last_pass", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN regexp_matches(trim(reading), '^[+-]?\\d+$') THEN TRY_CAST(reading AS DOUBLE) END AS number FROM {DIRTY_SQL} d""")
def _(spark, sf):
    return rounded(C.apply_plan(dirty_readings(spark, sf).select("l_orderkey", "l_linenumber", F.col("reading").alias("number")), {"number": "plain_number"}))


@query("cln10_auto_clean", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, reading, is_discounted = 'Yes' AS is_discounted,
  strftime(TRY_CAST(ship_text AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ship_text,
  CAST(regexp_extract(battery_capacity, '^(\\d+\\.\\d+)', 1) AS DOUBLE) AS battery_capacity, return_type FROM {DIRTY_SQL} d""")
def _(spark, sf):
    return rounded(C.auto_clean(dirty_readings(spark, sf)))


# --- nested ------------------------------------------------------------------------------------------

@query("nst02_unpack_struct", "SELECT p_partkey, CAST(p_size AS BIGINT) AS info_size, p_brand AS info_brand FROM part")
def _(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("info"))
    return rounded(N.unpack_struct(rows, "info").drop("info"))


@query("nst02_unpack_map", """
SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS m_click, CASE WHEN event_type = 'error' THEN value END AS m_error, CASE WHEN event_type = 'purchase' THEN value END AS m_purchase,
  CASE WHEN event_type = 'signup' THEN value END AS m_signup, CASE WHEN event_type = 'view' THEN value END AS m_view FROM events""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.create_map("event_type", "value").alias("m"))
    return N.unpack_map(rows, "m").drop("m")


@query("nst03_join_array", f"SELECT _id, array_to_string(MPRN, ' | ') AS \"MPRN_joined\" FROM {CONNECTIONS_SQL} c")
def _(spark, sf):
    return N.join_array(connections(spark, sf), "MPRN").select("_id", "MPRN_joined")


@query("nst04_flatten", "SELECT p_partkey AS a_key, p_name AS a_b_name, CAST(p_size AS BIGINT) AS a_b_size FROM part")
def _(spark, sf):
    rows = table(spark, sf, "part").select(F.struct(
        F.col("p_partkey").alias("key"), F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")).alias("b")
    ).alias("a"))
    return rounded(N.flatten(rows))


@query("nst05_unpack_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def _(spark, sf):
    return N.unpack(table(spark, sf, "events").select("event_id", "props")).select("event_id", "props_k")


# --- geometry ----------------------------------------------------------------------------------------

@F.pandas_udf(T.BinaryType())
def _building(east: pd.Series, north: pd.Series) -> pd.Series:
    """A square building as a headed WKB polygon; a negative easting gives unreadable bytes."""
    out = []
    for e, n in zip(east, north):
        ring = np.array([[e, n], [e + 20, n], [e + 20, n + 20], [e, n + 20], [e, n]])
        body = struct.pack("<BIII", 1, 3, 1, 5) + ring.astype("<f8").tobytes()
        out.append(b"\0" * 40 + body if e >= 0 else b"bad")
    return pd.Series(out)


def _buildings(spark, sf):
    key = F.col("c_custkey")
    broken = F.col("c_mktsegment") == "MACHINERY"
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.when(broken, F.lit(-1.0)).otherwise(200000.0 + key % 1000 * 300).alias("e"), (100000.0 + key % 777 * 600).alias("n")
    )
    # A Parquet row group is one task, and geometries are dear to decode: all cores share the keys.
    shared = rows.repartition(spark.sparkContext.defaultParallelism)
    return shared.select("c_custkey", _building(F.col("e"), F.col("n")).alias("geom"))


@query("geo01_decode")
def _(spark, sf):
    return G.with_geometry(_buildings(spark, sf))


@query("geo02_reproject")
def _(spark, sf):
    bounds = ("min_x", "min_y", "max_x", "max_y")
    return rounded(G.with_geometry(_buildings(spark, sf)).select("c_custkey", *bounds), 6)


@query("src07_geometry_layer", "SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 3 ELSE 133 END AS bytes FROM customer")
def _(spark, sf):
    """A building layer with its binary column, landed as Parquet; the same rows come from ``read_jdbc``."""
    path = fresh_path(spark, "layer")
    overwrite(_buildings(spark, sf), path)
    return rounded(read_folder(spark, path).select("c_custkey", F.length("geom").alias("bytes")))


@query("geo03_text_forms")
def _(spark, sf):
    return G.with_geometry(_buildings(spark, sf)).select("c_custkey", "wkt", "geojson")


@query("geo04_validity", """
WITH b AS (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal / 100 END AS x1, c_acctbal / 100 + c_nationkey % 3 AS x2, 50.0 AS y1, 50.0 + c_nationkey % 3 AS y2 FROM customer)
SELECT c_custkey, CASE WHEN x1 IS NULL THEN false WHEN x1 >= -10 AND x2 <= 10 AND y1 >= 49 AND y2 <= 61 THEN true WHEN x1 = x2 AND y1 = y2 THEN false ELSE true END AS is_valid FROM b""")
def _(spark, sf):
    x, span = F.col("c_acctbal") / 100, F.col("c_nationkey") % 3
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") <= 5000, x).alias("min_x"), (x + span).alias("max_x"),
        F.lit(50.0).alias("min_y"), (span + 50.0).alias("max_y"),
    )
    return G.with_validity(rows).select("c_custkey", "is_valid")


@query("geo05_counts", """
SELECT count(*) AS rows, count(*) FILTER (c_mktsegment <> 'MACHINERY') AS decoded, count(*) FILTER (c_mktsegment = 'MACHINERY') AS undecoded, 0 AS invalid FROM customer""")
def _(spark, sf):
    return G.geometry_counts(G.with_validity(G.with_geometry(_buildings(spark, sf))))
