"""PRJ, FLT and LIM queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake.catalog.base import query, rounded
from emberlake.operators import filters as FL
from emberlake.operators import limits as L
from emberlake.operators import project as P
from emberlake.plans.stand_ins import CONNECTIONS_SQL, DIRTY_SQL, QUERY_LOG_SQL, connections, dirty_readings, meters, query_log
from emberlake.plans.meters import consumption_long
from emberlake.plans.stand_ins import METERS_SQL
from emberlake.sources.readers import table
from emberlake.spec import CONNECTIONS, CollectionSpec, DictionaryEntry, TableSpec

LINES = TableSpec(
    "lines", key_columns=("l_orderkey", "l_linenumber"), id_columns=("l_orderkey", "l_linenumber"), date_column="l_shipdate",
    numeric=("reading",), datetime=("ship_text",),
)
ORDERS = TableSpec("orders", date_column="o_orderdate")
DOCUMENTS = CollectionSpec("documents", essential_columns=("doc_id", "lang", "text"), dictionary=(DictionaryEntry("text", max_length=40),), max_rows=20)


@query("prj01_coerce_declared", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, TRY_CAST(reading AS DOUBLE) AS reading,
  strftime(TRY_CAST(ship_text AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ship_text FROM {DIRTY_SQL} d""")
def _(spark, sf):
    return rounded(P.coerce_declared(dirty_readings(spark, sf), LINES).select("l_orderkey", "l_linenumber", "reading", "ship_text"))


@query("prj02_year_month", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS lodgement_year, CAST(month(o_orderdate) AS BIGINT) AS lodgement_month FROM orders""")
def _(spark, sf):
    return rounded(P.with_year_month(table(spark, sf, "orders"), "O_ORDERDATE").select("o_orderkey", "lodgement_year", "lodgement_month"))


@query("prj03_month_start", """
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS date, strftime(o_orderdate, '%Y-%m') AS year_month FROM orders""")
def _(spark, sf):
    keys = ("lodgement_year", "lodgement_month")
    df = P.with_year_month(table(spark, sf, "orders"), "o_orderdate")
    return rounded(P.with_year_month_label(P.with_month_start(df, *keys), *keys).select("o_orderkey", "date", "year_month"))


@query("prj04_keep_configured", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    return P.keep_configured(table(spark, sf, "orders"), ["o_orderkey", "absent", "o_orderstatus"])


@query("prj05_keep_essential", "SELECT doc_id, lang, text FROM documents")
def _(spark, sf):
    return P.keep_essential(table(spark, sf, "documents"), DOCUMENTS)


@query("prj06_document_projection", f"""
SELECT array_to_string(UPRN, ';') AS "UPRN", array_to_string(EMSN, ';') AS "EMSN", array_to_string(MPAN, ';') AS "MPAN", array_to_string(MPRN, ';') AS "MPRN",
  array_to_string(POSTCODE, ';') AS "POSTCODE", array_to_string(ADDRESS, ';') AS "ADDRESS" FROM {CONNECTIONS_SQL} c""")
def _(spark, sf):
    return rounded(P.document_projection(connections(spark, sf), CONNECTIONS))


@query("prj07_truncate_text", """
SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS text, lang, source FROM documents""")
def _(spark, sf):
    return P.truncate_text(table(spark, sf, "documents"), {"text": 40}).select("doc_id", "text", "lang", "source")


@query("prj08_rename_aliases", "SELECT p_partkey AS part_id, p_name AS part_name FROM part")
def _(spark, sf):
    return P.rename_aliases(table(spark, sf, "part"), {"p_partkey": "part_id", "p_name": "part_name", "none": "x"}).select("part_id", "part_name")


@query("prj09_cast_columns", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, TRY_CAST(reading AS DOUBLE) AS reading,
  CASE WHEN regexp_matches(battery_capacity, '\\.\\.\\.$') THEN NULL ELSE CAST(trunc(CAST(battery_capacity AS DOUBLE)) AS BIGINT) END AS battery_capacity
FROM {DIRTY_SQL} d""")
def _(spark, sf):
    return rounded(P.cast_columns(dirty_readings(spark, sf), ["reading"], ["battery_capacity"]).select(
        "l_orderkey", "l_linenumber", "reading", "battery_capacity"))


@query("prj10_row_text", f"""
SELECT CAST(event_id AS STRING) || ' | ' || coalesce(component, 'None') || ' | ' || coalesce(CAST(user_satisfaction AS STRING), 'None') AS row_text
FROM {QUERY_LOG_SQL} q""")
def _(spark, sf):
    return P.row_text(query_log(spark, sf).select("event_id", "component", "user_satisfaction")).select("row_text")


@query("prj11_labelled_text", """
SELECT p_partkey, concat_ws(' | ', 'UPRN: ' || CAST(p_partkey AS STRING),
  CASE WHEN p_size > 25 THEN 'Property type: ' || p_type END, 'Bedrooms: ' || CAST(p_size AS STRING), 'Address: ' || p_brand || ' ' || p_name) AS text FROM part""")
def _(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_partkey").alias("uprn_link"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("premise_type"),
        F.col("p_size").alias("bedroom_count"), F.col("p_brand").alias("building_name"), F.col("p_name").alias("street_name"),
    )
    return P.labelled_text(rows).select("p_partkey", "text")


@query("prj12_composite_id", "SELECT CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS unique_id FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(P.composite_id(["l_orderkey", "l_linenumber"]).alias("unique_id"))


_ROW = " || ',' || ".join(
    [f"""'"{c}":' || {c}""" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    + [f"""'"{c}":"' || {c} || '"'""" for c in ("l_returnflag", "l_linestatus")]
    + ["""'"l_shipdate":"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%g') || '"'"""]
)


@query("prj12_row_hash", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, sha256('{{' || {_ROW} || '}}') AS row_key FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(df.select("l_orderkey", "l_linenumber", P.row_hash(df).alias("row_key")))


@query("prj13_payload", "SELECT vec_id, CAST(label AS BIGINT) AS payload_label, vec_id AS payload_id FROM embeddings")
def _(spark, sf):
    df = table(spark, sf, "embeddings")
    packed = df.select("vec_id", P.payload(df).alias("payload"))
    return rounded(packed.select("vec_id", F.col("payload.label").alias("payload_label"), F.col("payload.vec_id").alias("payload_id")))


@query("prj14_json_payload", """
SELECT user_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","when":"' || strftime(ts, '%Y-%m-%d') || '","bytes":null,"ratio":'
  || CASE WHEN event_type = 'error' THEN 'null' ELSE '0.5' END || ',"tags":["' || event_type || '"]}' AS payload FROM events""")
def _(spark, sf):
    nan = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.lit(0.5))
    rows = table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", F.col("ts").cast("date").alias("when"), F.encode("event_type", "UTF-8").alias("bytes"),
        nan.alias("ratio"), F.array("event_type").alias("tags"),
    )
    return rows.select("user_id", P.json_payload(rows, exclude=["user_id"]).alias("payload"))


@query("prj15_unpivot", f"""
WITH s AS (SELECT fuelType, sum(consumption) FILTER (readingType = 'Estimated') AS e, sum(consumption) FILTER (readingType = 'Actual') AS a FROM {METERS_SQL} m GROUP BY 1)
SELECT fuelType, 'Estimated' AS "Type", round(e, 2) AS "Consumption" FROM s UNION ALL SELECT fuelType, 'Actual', round(a, 2) FROM s""")
def _(spark, sf):
    return rounded(consumption_long(meters(spark, sf)), 2)


@query("prj16_chat_text", """
SELECT q.conv_id, q.turn, '<|user|>' || chr(10) || q.text || chr(10) || '<|assistant|>' || chr(10) || a.text AS text
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'""")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(told, ["conv_id", "turn"]).select("conv_id", "turn", P.chat_text(F.col("question"), F.col("answer")).alias("text"))


@query("prj17_format_moment", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", P.format_moment(F.col("ts")).alias("at"))


@query("prj18_shortened", "SELECT conv_id, turn, left(text, 100) AS text, length(text) AS length FROM conversations")
def _(spark, sf):
    return rounded(table(spark, sf, "conversations").select("conv_id", "turn", P.shortened(F.col("text")).alias("text"), F.length("text").alias("length")))


@query("prj19_ratio", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_discount / nullif(l_tax, 0) * 100, 2) AS ratio FROM lineitem")
def _(spark, sf):
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.percent_ratio(F.col("l_discount"), F.col("l_tax")).alias("ratio")))


# --- filters -----------------------------------------------------------------------------------------

@query("flt01_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1997-06-30'")
def _(spark, sf):
    return FL.in_date_range(table(spark, sf, "orders"), ORDERS, "1996-01-01", "1997-06-30").select("o_orderkey")


@query("flt02_keywords", "SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%' OR p_name ILIKE '%blue%' OR p_type ILIKE '%ring%' OR p_type ILIKE '%blue%' OR p_brand ILIKE '%ring%' OR p_brand ILIKE '%blue%'")
def _(spark, sf):
    return FL.matching_keywords(table(spark, sf, "part"), ["Ring", "blue"]).select("p_partkey")


@query("flt03_composite_keys", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_shipdate >= '1997-01-01'
  AND (l_orderkey, l_suppkey) IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    keys = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    recent = lines.where(F.col("l_shipdate") >= "1997-01-01")
    return rounded(FL.with_keys(recent, keys, ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_linenumber"))


@query("flt04_array_has", f"SELECT _id FROM {CONNECTIONS_SQL} c WHERE list_contains(MPRN, '9200000300')")
def _(spark, sf):
    return connections(spark, sf).where(FL.array_has("MPRN", "9200000300")).select("_id")


@query("flt05_array_prefix", f"SELECT _id FROM {CONNECTIONS_SQL} c WHERE regexp_matches(POSTCODE[1], '^(NT|NS)', 'i')")
def _(spark, sf):
    return connections(spark, sf).where(FL.array_has_prefix("POSTCODE", ["nt", "NS"])).select("_id")


@query("flt06_array_part", f"SELECT _id FROM {CONNECTIONS_SQL} c WHERE contains(ADDRESS[1], 'MACHINERY')")
def _(spark, sf):
    return connections(spark, sf).where(FL.array_has_part("ADDRESS", ["machinery"])).select("_id")


@query("flt07_number_fallback", "SELECT doc_id, nullif(regexp_extract(text, '(\\d+)', 1), '') AS number FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", FL.number_in_question(F.col("text")).alias("number"))


@query("flt08_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^s.*ring$', 'i') OR regexp_matches(p_brand, '^s.*ring$', 'i')")
def _(spark, sf):
    return FL.matching_regex(table(spark, sf, "part"), ["p_name", "p_brand"], "^S.*ring$").select("p_partkey")


@query("flt10_value_map", f"SELECT event_id FROM {QUERY_LOG_SQL} q WHERE log_level = 'info' AND event_type IN ('view', 'signup')")
def _(spark, sf):
    return FL.matching_values(query_log(spark, sf), {"log_level": "info", "event_type": ["view", "signup"]}).select("event_id")


@query("flt11_drop_nulls", f"SELECT event_id FROM {QUERY_LOG_SQL} q WHERE component IS NOT NULL AND user_satisfaction IS NOT NULL")
def _(spark, sf):
    return query_log(spark, sf).dropna(subset=["component", "user_satisfaction"]).select("event_id")


_FALLBACK = """SELECT {col} AS value, count(*) AS count FROM part WHERE {where} GROUP BY 1"""


@query("flt12_counts_both", _FALLBACK.format(col="p_type", where="p_name ILIKE '%ring%' AND p_type ILIKE '%s%'"))
def _(spark, sf):
    return FL.counts_or_fallback(table(spark, sf, "part"), ("p_name", "RING"), ("p_type", "s"))


@query("flt12_counts_fallback", _FALLBACK.format(col="p_name", where="p_name ILIKE '%ring%'"))
def _(spark, sf):
    return FL.counts_or_fallback(table(spark, sf, "part"), ("p_name", "ring"), ("p_type", "nowhere"))


@query("flt13_field_exists", f"SELECT event_id FROM {QUERY_LOG_SQL} q WHERE component IS NOT NULL")
def _(spark, sf):
    return query_log(spark, sf).where(F.col("component").isNotNull()).select("event_id")


@query("flt14_key_range", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 3000")
def _(spark, sf):
    return FL.key_range(table(spark, sf, "orders"), "o_orderkey", 1000, 3000).select("o_orderkey")


@query("flt14_next_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 40 ORDER BY 1 LIMIT 20")
def _(spark, sf):
    return FL.page_after(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 40)


@query("flt15_retention", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS")
def _(spark, sf):
    return FL.newer_than(table(spark, sf, "events"), "ts", "2024-01-31 00:00:00", 7).select("event_id")


@query("flt15_removed_count", """
SELECT count(*) FILTER (ts <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS) AS removed,
  count(*) FILTER (ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS) AS kept FROM events""")
def _(spark, sf):
    return FL.removed_count(table(spark, sf, "events"), "ts", "2024-01-31 00:00:00", 7)


# --- samples and heads -------------------------------------------------------------------------------

@query("lim01_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS STRING) || '|42'), doc_id LIMIT 500")
def _(spark, sf):
    return L.sample_rows(table(spark, sf, "documents").select("doc_id"), ["doc_id"])


@query("lim02_basic_context", "SELECT doc_id, text FROM documents ORDER BY md5(CAST(doc_id AS STRING) || '|42'), doc_id LIMIT 10")
def _(spark, sf):
    return L.basic_context(table(spark, sf, "documents"), ["doc_id"], ["doc_id", "text"])


@query("lim04_page", "SELECT o_orderkey FROM orders ORDER BY 1 OFFSET 40 LIMIT 20")
def _(spark, sf):
    return FL.page(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 2)


@query("lim05_head", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY 1 LIMIT 1000")
def _(spark, sf):
    return L.head(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), 1000, ["o_orderkey"])


@query("lim06_newest", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 5")
def _(spark, sf):
    return L.newest(table(spark, sf, "events"), "ts", ["event_id"]).select("event_id")


@query("lim08_context", """
SELECT doc_id, lang, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS text FROM documents
ORDER BY md5(CAST(doc_id AS STRING) || '|42'), doc_id LIMIT 20""")
def _(spark, sf):
    return L.optimised_context(table(spark, sf, "documents"), DOCUMENTS, ["doc_id"])
