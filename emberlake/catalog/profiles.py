"""PRF queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from emberlake.catalog.base import query, rounded
from emberlake.operators import profile as P
from emberlake.plans.stand_ins import CONNECTIONS_SQL, DIRTY_SQL, QUERY_LOG_SQL, connections, dirty_readings, query_log
from emberlake.sources.readers import table

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _each(columns, template: str, source: str) -> str:
    return " UNION ALL ".join("SELECT '" + c + "' AS \"column\", " + template.replace("{c}", c) + " FROM " + source for c in columns)


@query("prf01_overview", "SELECT count(*) AS rows, 3 AS columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem)) AS duplicates FROM lineitem")
def _(spark, sf):
    return rounded(P.overview(table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")))


_LOG_COLUMNS = ("event_id", "user_id", "user_satisfaction", "component", "log_level")


@query("prf02_null_report", _each(_LOG_COLUMNS, "count(*) FILTER ({c} IS NULL) AS nulls, round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 4) AS null_percent", QUERY_LOG_SQL + " q"))
def _(spark, sf):
    return rounded(P.null_report(query_log(spark, sf), _LOG_COLUMNS))


@query("prf04_describe", _each(NUMBERS, """count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
  round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max""", "lineitem"))
def _(spark, sf):
    return rounded(P.describe_numeric(table(spark, sf, "lineitem"), NUMBERS))


@query("prf04_describe_approximate")
def _(spark, sf):
    return rounded(P.describe_numeric(table(spark, sf, "lineitem"), NUMBERS, approximate=True))


_TEXTS = ("event_type", "component", "props")
_COUNTED = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count FROM {QUERY_LOG_SQL} q GROUP BY 2" for c in _TEXTS)


@query("prf05_top_values", f"""
WITH n AS ({_COUNTED}), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value NULLS LAST) AS rank FROM n)
SELECT * FROM r WHERE rank <= 5""")
def _(spark, sf):
    return rounded(P.top_values(query_log(spark, sf), _TEXTS))


@query("prf06_context_profile", """
WITH n AS (SELECT 'p_name' AS "column", p_name AS value, count(*) AS count FROM part GROUP BY 2
  UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM n),
s AS (SELECT 'p_partkey' AS "column", min(p_partkey)::DOUBLE AS a, max(p_partkey)::DOUBLE AS b, avg(p_partkey) AS m FROM part
  UNION ALL SELECT 'p_size', min(p_size), max(p_size), avg(p_size) FROM part
  UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice), avg(p_retailprice) FROM part)
SELECT 'value' AS kind, "column", rank, value, CAST(NULL AS DOUBLE) AS number FROM r WHERE rank <= 10
UNION ALL SELECT 'statistic', "column", 0, 'min', round(a, 4) FROM s UNION ALL SELECT 'statistic', "column", 0, 'max', round(b, 4) FROM s
UNION ALL SELECT 'statistic', "column", 0, 'mean', round(m, 4) FROM s""")
def _(spark, sf):
    return rounded(P.context_profile(table(spark, sf, "part")))


@query("prf06_context_text", """
WITH n AS (SELECT 'p_name' AS "column", p_name AS value, count(*) AS count FROM part GROUP BY 2
  UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM n),
s AS (SELECT 'p_partkey' AS "column", min(p_partkey)::DOUBLE AS a, max(p_partkey)::DOUBLE AS b, avg(p_partkey) AS m FROM part
  UNION ALL SELECT 'p_size', min(p_size), max(p_size), avg(p_size) FROM part
  UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice), avg(p_retailprice) FROM part)
SELECT 'value' AS kind, "column", string_agg(value, ', ' ORDER BY rank) AS line FROM r WHERE rank <= 10 GROUP BY 2
UNION ALL SELECT 'statistic', "column", printf('max=%.2f, mean=%.2f, min=%.2f', b, m, a) FROM s""")
def _(spark, sf):
    return P.context_text(P.context_profile(table(spark, sf, "part")))


@query("prf07_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in combinations(NUMBERS, 2)))
def _(spark, sf):
    return rounded(P.correlations(table(spark, sf, "lineitem"), NUMBERS), 6)


@query("prf08_shape", _each(NUMBERS, "round(skewness({c}), 2) + 0 AS skewness, round(kurtosis({c}), 2) + 0 AS kurtosis", "lineitem"))
def _(spark, sf):
    return rounded(P.distribution_shape(table(spark, sf, "lineitem"), NUMBERS), 2)




@query("prf09_iqr_outliers", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers,
  round(count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*), 2) AS outlier_percent
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {t}), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {t})"""
    for c, t in (("l_extendedprice", "lineitem"), ("price_per_item", "(SELECT l_extendedprice / l_quantity AS price_per_item FROM lineitem)"))))
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_item"))
    return rounded(P.iqr_outliers(lines), 2)


@query("prf10_zscore_outliers", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER (abs(v - m) > 3 * s) AS outliers, round(count(*) FILTER (abs(v - m) > 3 * s) * 100.0 / count(*), 2) AS outlier_percent
FROM (SELECT {e} AS v FROM lineitem), (SELECT avg({e}) AS m, stddev_pop({e}) AS s FROM lineitem)"""
    for c, e in (("l_tax", "l_tax"), ("price_per_item", "l_extendedprice / l_quantity"))))
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_tax", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_item"))
    return rounded(P.zscore_outliers(lines), 2)


@query("prf11_insights", f"""
WITH q AS (SELECT user_satisfaction, exp(duration) AS grown, 'same' AS fixed, event_type FROM {QUERY_LOG_SQL} l)
SELECT 'high_missing' AS rule, 'user_satisfaction' AS "column" FROM q HAVING count(*) FILTER (user_satisfaction IS NULL) * 100.0 / count(*) > 30
UNION ALL SELECT 'skewed', 'grown' FROM q HAVING abs(skewness(grown)) > 1
UNION ALL SELECT 'constant', 'fixed' FROM q HAVING count(DISTINCT fixed) = 1
UNION ALL SELECT 'constant', 'event_type' FROM q HAVING count(DISTINCT event_type) = 1""")
def _(spark, sf):
    return P.insights(query_log(spark, sf).select("user_satisfaction", F.exp("duration").alias("grown"), F.lit("same").alias("fixed"), "event_type"))


@query("prf12_means_by_date", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, round(avg(value), 4) AS mean_value, round(avg(user_id), 4) AS mean_user_id FROM events GROUP BY 1""")
def _(spark, sf):
    return rounded(P.means_by_date(table(spark, sf, "events").withColumn("day", F.col("ts").cast("date")), "day", ["value", "user_id"]))


@query("prf13_question_profile", "SELECT 'l_tax' AS a, 'l_discount' AS b, round(corr(l_tax, l_discount), 6) AS r FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', NULL FROM lineitem WHERE false")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_tax", "l_quantity", "l_discount")
    return rounded(P.profile_for_question(lines, "How does L_TAX depend on l_discount?")["correlations"], 6)


_QUALITY = ("component", "user_satisfaction", "log_level", "event_id")
_QUALITY_TEXT = ("component", "log_level")


def _quality_sql() -> str:
    parts = []
    for c in _QUALITY:
        distinct = f"count(DISTINCT {c}) * 1.0 / count(*)" if c in _QUALITY_TEXT else "CAST(NULL AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} IS NULL) * 1.0 / count(*) AS share,
          {distinct} AS distinct_share FROM {QUERY_LOG_SQL} q""")
    return f"""WITH p AS ({' UNION ALL '.join(parts)})
SELECT "column", nulls, round(share * 100, 4) AS null_percent, round(distinct_share, 4) AS distinct_share, round(1 - share, 4) AS score,
  CASE WHEN share > 0.5 THEN 'many missing values' WHEN distinct_share IS NOT NULL AND share < 0.2 AND distinct_share < 0.1 THEN 'low cardinality' ELSE '' END AS advice FROM p
UNION ALL SELECT '*', CAST(sum(nulls) AS BIGINT), round(avg(share) * 100, 4), NULL, round(avg(1 - share), 4),
  CASE WHEN avg(1 - share) < 0.7 THEN 'low overall quality' ELSE '' END FROM p"""


@query("prf14_quality_report", _quality_sql())
def _(spark, sf):
    return rounded(P.quality_report(query_log(spark, sf).select(*_QUALITY)))


@query("prf15_array_lengths", f"""
SELECT 'embedding' AS "column", CAST(min(len(embedding)) AS BIGINT) AS min_length, CAST(max(len(embedding)) AS BIGINT) AS max_length, avg(len(embedding)) AS avg_length FROM embeddings""")
def _(spark, sf):
    return rounded(P.array_lengths(table(spark, sf, "embeddings")))


@query("prf15_document_arrays", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(min(len({c})) AS BIGINT) AS min_length, CAST(max(len({c})) AS BIGINT) AS max_length, avg(len({c})) AS avg_length FROM {CONNECTIONS_SQL} x"
    for c in ("UPRN", "EMSN", "MPAN", "MPRN", "POSTCODE", "ADDRESS")))
def _(spark, sf):
    return rounded(P.array_lengths(connections(spark, sf)))


@query("prf16_value_shapes", """
WITH e AS (SELECT props, md5(CAST(event_id AS STRING))[1:24] AS object_id, CASE event_id % 3 WHEN 0 THEN '12' WHEN 1 THEN 'word' ELSE '1.5' END AS mixed_text FROM events)
SELECT 'props' AS "column", 0.0::DOUBLE AS object_id_percent, 100.0::DOUBLE AS json_percent, 1 AS kinds, false AS mixed
UNION ALL SELECT 'object_id', 100.0::DOUBLE, 0.0::DOUBLE, (count(*) FILTER (regexp_matches(object_id, '^\\d+$')) > 0)::INT
  + (count(*) FILTER (regexp_matches(object_id, '^\\d+e\\d+$')) > 0)::INT + 1,
  (count(*) FILTER (regexp_matches(object_id, '^\\d+$')) > 0)::INT + (count(*) FILTER (regexp_matches(object_id, '^\\d+e\\d+$')) > 0)::INT + 1 > 2 FROM e
UNION ALL SELECT 'mixed_text', 0.0::DOUBLE, 0.0::DOUBLE, 3, true""")
def _(spark, sf):
    turn = F.col("event_id") % 3
    rows = table(spark, sf, "events").select(
        "props", F.left(F.md5(F.col("event_id").cast("string")), F.lit(24)).alias("object_id"),
        F.when(turn == 0, "12").when(turn == 1, "word").otherwise("1.5").alias("mixed_text"),
    )
    return rounded(P.value_shapes(rows))


_UNIT_NUMBER = r"^\d+\.?\d*\s*(kwh/100km?|l/100km?|kwh|kw|wh|w|kah|mah|ah|km|mi|mpg)$"
_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"


@query("prf17_numeric_likeness", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(count(*) FILTER (regexp_matches(trim({c}), '{_UNIT_NUMBER}', 'i') OR regexp_matches(trim({c}), '{_PLAIN}', 'i')) * 100.0 / count({c}), 4) AS numeric_percent,
  count(*) FILTER (regexp_matches(trim({c}), '{_UNIT_NUMBER}', 'i') OR regexp_matches(trim({c}), '{_PLAIN}', 'i')) * 100.0 / count({c}) > 50 AS should_be_numeric FROM {DIRTY_SQL} d"""
    for c in ("reading", "battery_capacity")))
def _(spark, sf):
    return rounded(P.numeric_likeness(dirty_readings(spark, sf), ["reading", "battery_capacity"]))


@query("prf18_collection_info", """
WITH j AS (SELECT length('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":' || p_size || '}') AS n FROM part)
SELECT 'part' AS collection, count(*) AS documents, 'p_partkey,p_name,p_size' AS fields, round(avg(n), 4) AS avg_size, CAST(sum(n) AS BIGINT) AS total_size FROM j""")
def _(spark, sf):
    return rounded(P.collection_info(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "part"))


@query("prf19_storage_estimate", """
WITH s AS (SELECT count(*) AS count, CAST(max(len(embedding)) AS BIGINT) AS vector_size FROM embeddings),
b AS (SELECT *, count * (vector_size * 4 + 600) AS estimated_bytes FROM s)
SELECT *, CASE WHEN estimated_bytes >= 1048576 THEN printf('%.2f MB', estimated_bytes / 1048576.0) ELSE printf('%.2f KB', estimated_bytes / 1024.0) END AS estimated_size FROM b""")
def _(spark, sf):
    return rounded(P.storage_estimate(table(spark, sf, "embeddings")))


@query("prf20_key_bounds", "SELECT min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, count(o_orderkey) AS keys FROM orders")
def _(spark, sf):
    return P.key_bounds(table(spark, sf, "orders"), "o_orderkey")


@query("prf21_progress_report", """
WITH p AS (SELECT source AS collection, CASE WHEN source = 'src0' THEN -1 ELSE max(doc_id) END AS "offset" FROM documents GROUP BY 1)
SELECT collection, CASE WHEN "offset" = -1 THEN 'COMPLETED' ELSE 'IN PROGRESS' END AS status, CASE WHEN "offset" <> -1 THEN "offset" END AS last_offset,
  CASE WHEN "offset" <> -1 THEN "offset" // 1000 END AS batches FROM p""")
def _(spark, sf):
    rows = table(spark, sf, "documents").groupBy(F.col("source").alias("collection")).agg(F.max("doc_id").alias("last"))
    return P.progress_report(rows.select("collection", F.when(F.col("collection") == "src0", F.lit(-1)).otherwise(F.col("last")).alias("offset")))


# Objects with a key of their own per event type; the kind of "k" varies.
_OBJECTS = """CASE event_type WHEN 'click' THEN props WHEN 'error' THEN '{"k": "x", "codes": [1, 2]}' ELSE '{"' || event_type || '": {"deep": ' || CAST(event_id % 7 AS STRING) || '.5}}' END"""


@query("prf22_json_structure", """
SELECT key, kind, count(*) AS count FROM (
  SELECT unnest(CASE event_type WHEN 'click' THEN [{key: '$.k', kind: 'BIGINT'}] WHEN 'error' THEN [{key: '$.k', kind: 'STRING'}, {key: '$.codes', kind: 'ARRAY'}]
    ELSE [{key: '$.' || event_type, kind: 'OBJECT'}, {key: '$.' || event_type || '.deep', kind: 'DECIMAL'}] END, recursive := true) FROM events) GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(P.json_structure(table(spark, sf, "events").select(F.expr(_OBJECTS).alias("text")), "text"))


@query("prf22_field_structure", f"""
SELECT unnest([{{field: '_id', type: 'bigint', max_length: NULL::BIGINT}}, {{field: 'UPRN', type: 'array<string>', max_length: max(len("UPRN"))}}, {{field: 'EMSN', type: 'array<string>', max_length: max(len("EMSN"))}},
  {{field: 'MPAN', type: 'array<string>', max_length: max(len("MPAN"))}}, {{field: 'MPRN', type: 'array<string>', max_length: max(len("MPRN"))}}, {{field: 'POSTCODE', type: 'array<string>', max_length: max(len("POSTCODE"))}},
  {{field: 'ADDRESS', type: 'array<string>', max_length: max(len("ADDRESS"))}}, {{field: 'api_ok', type: 'string', max_length: NULL::BIGINT}}], recursive := true) FROM {CONNECTIONS_SQL} c""")
def _(spark, sf):
    return rounded(P.field_structure(connections(spark, sf)))
