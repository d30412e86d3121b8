"""LOG, MET and LRN queries, and the ring buffer LIM-07."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake.catalog.base import query, rounded, token_slots_sql
from emberlake.operators import learning as LE
from emberlake.operators import logs as LO
from emberlake.operators.vector import embed_text
from emberlake.plans.stand_ins import QUERY_LOG_SQL, query_log
from emberlake.sources.readers import table

LOG = f"{QUERY_LOG_SQL} q"
AS_OF = "2024-01-20 12:00:00"
WINDOW = f"ts > TIMESTAMP '{AS_OF}' - INTERVAL 10080 MINUTES AND ts <= TIMESTAMP '{AS_OF}'"
WEEK = 7 * 24 * 60


def _dimensions(names, source: str = LOG) -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS STRING), 'unknown') AS value, count(*) AS count FROM {source} GROUP BY 2" for d in names
    )


@query("log01_summary", _dimensions(LO.DIMENSIONS))
def _(spark, sf):
    return LO.logs_summary(query_log(spark, sf))


@query("log01_totals", f"SELECT count(*) AS total_logs, count(DISTINCT coalesce(CAST(user_id AS STRING), 'unknown')) AS active_users FROM {LOG}")
def _(spark, sf):
    return LO.logs_totals(query_log(spark, sf))


@query("log02_top_users", f"SELECT CAST(user_id AS STRING) AS user_id, count(*) AS count FROM {LOG} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return LO.top_users(query_log(spark, sf))


@query("log03_errors", _dimensions(("component", "event_type"), f"{LOG} WHERE log_level = 'error'"))
def _(spark, sf):
    return LO.errors_by(query_log(spark, sf))


@query("log04_durations", f"""
SELECT 1 AS overall, CAST(NULL AS STRING) AS operation, CAST(NULL AS STRING) AS component, count(*) AS count, round(avg(duration), 4) AS avg_duration,
  round(max(duration), 4) AS max_duration, round(min(duration), 4) AS min_duration FROM {LOG}
UNION ALL SELECT 0, operation, component, count(*), round(avg(duration), 4), round(max(duration), 4), round(min(duration), 4) FROM {LOG} GROUP BY operation, component""")
def _(spark, sf):
    return rounded(LO.duration_stats(query_log(spark, sf)))


@query("log04_histogram", f"""
SELECT component, CASE WHEN duration < 0 THEN 0 WHEN duration >= 10 THEN 21 ELSE CAST(floor(duration / 0.5) AS BIGINT) + 1 END AS bucket, count(*) AS count FROM {LOG} GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(LO.duration_histogram(query_log(spark, sf), 0, 10, 20))


@query("log05_user_activity", f"SELECT event_id, event_type FROM {LOG} WHERE user_id = 8")
def _(spark, sf):
    return LO.user_activity(query_log(spark, sf), 8).select("event_id", "event_type")


@query("log06_error_events", f"""
SELECT event_id, 'error' AS event_type, 'error' AS log_level, component, 'failed: ' || props AS message,
  concat_ws(' ', 'error', 'error', component, 'failed: ' || props) AS search_text, event_type AS error_type FROM {LOG} WHERE event_type = 'error'""")
def _(spark, sf):
    rows = query_log(spark, sf).where("event_type = 'error'").select(
        "event_id", "component", F.col("event_type").alias("error_type"), F.concat(F.lit("failed: "), F.col("props")).alias("error_message"), F.lit("").alias("user_message")
    )
    return LO.error_events(rows).select(
        "event_id", "event_type", "log_level", "component", "message", "search_text", F.col("error_info")["error_type"].alias("error_type")
    )


@query("log06_question_events", """
SELECT conv_id AS event_id, 'RAG query: ' || left(text, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS message, CAST(length(text) AS STRING) AS size
FROM conversations WHERE role = 'user'""")
def _(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'user'").select(
        F.col("conv_id").alias("event_id"), F.col("text").alias("question"), F.lit("documents").alias("tables"), F.lit("exact").alias("engine")
    )
    return LO.question_events(rows).select("event_id", "message", F.col("details")["question_length"].alias("size"))


@query("log06_performance_events", f"""
SELECT event_id, 'Performance: ' || operation || ' took ' || printf('%.2f', CAST(round(duration * 50) AS DOUBLE)) || 's' AS message, 'info' AS log_level FROM {LOG}""")
def _(spark, sf):
    rows = query_log(spark, sf).withColumn("duration", F.round(F.col("duration") * 50))
    return LO.performance_events(rows).select("event_id", "message", "log_level")


@query("log06_login_and_code_events", f"""
SELECT event_id, CASE WHEN success THEN 'info' ELSE 'error' END AS log_level,
  'Authentication ' || CASE WHEN success THEN 'successful' ELSE 'failed' END || ' via token' AS login, 'Code generation ' || CASE WHEN success THEN 'successful' ELSE 'failed' END || ' with x' AS code,
  'SQL query executed: ' || user_id || ' rows returned' AS sql FROM {LOG}""")
def _(spark, sf):
    rows = query_log(spark, sf).select(
        "event_id", "success", F.lit("token").alias("auth_method"), F.lit("bad").alias("error_message"), F.col("props").alias("question"),
        F.lit("df1").alias("generated_code"), F.lit("x").alias("provider"), F.lit("select 1").alias("sql_query"), F.col("duration").alias("execution_time"),
        F.col("user_id").alias("row_count"),
    )
    login = LO.login_events(rows).select("event_id", "log_level", F.col("message").alias("login"))
    code = LO.code_events(rows).select("event_id", F.col("message").alias("code"))
    return login.join(code, "event_id").join(LO.sql_events(rows).select("event_id", F.col("message").alias("sql")), "event_id")


_ASKED = "error error part-3"


@query("vec10_search_logs", f"""
WITH logs AS (SELECT event_id, event_type, component, concat_ws(' ', event_type, log_level, component, props) AS text FROM {LOG}),
texts AS (SELECT event_id, text FROM logs WHERE event_type IN ('error', 'click') UNION ALL SELECT -1, '{_ASKED}'), {token_slots_sql("texts", "event_id", "text", 64)},
v AS (SELECT key, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS w FROM slots),
norms AS (SELECT key, sqrt(sum(w * w)) AS size FROM v GROUP BY key),
scored AS (SELECT key AS event_id, round(coalesce(dot, 0) / (size * (SELECT size FROM norms WHERE key = -1) + 1e-8), 9) AS score
  FROM norms LEFT JOIN (SELECT a.key, sum(a.w * b.w) AS dot FROM v a JOIN v b ON a.slot = b.slot AND b.key = -1 GROUP BY a.key) USING (key) WHERE key <> -1)
SELECT event_id, event_type, component, round(score, 6) AS score FROM scored JOIN logs USING (event_id) ORDER BY scored.score DESC, event_id LIMIT 50""")
def _(spark, sf):
    """From a question in words to the logs nearest to it."""
    logs = embed_text(query_log(spark, sf).withColumn("text", F.concat_ws(" ", "event_type", "log_level", "component", "props")), "text")
    wanted = embed_text(spark.createDataFrame([(_ASKED,)], "text string"), "text").first().embedding
    hits = LO.search_logs(logs.select("event_id", "event_type", "component", "props", "embedding"), wanted, {"event_type": ["error", "click"]})
    return hits.select("event_id", "event_type", "component", F.round("score", 6).alias("score"))


@query("lim07_ring_buffer", f"""
WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM {LOG})
SELECT event_type, event_id FROM r WHERE n <= 1000""")
def _(spark, sf):
    return LO.last_samples(query_log(spark, sf), "event_type").select("event_type", "event_id")


# --- metrics -----------------------------------------------------------------------------------------

@query("met01_query_performance", f"""
SELECT count(*) AS count, round(avg(duration), 4) AS avg_duration, round(min(duration), 4) AS min_duration, round(max(duration), 4) AS max_duration,
  round(count(*) FILTER (success) * 100.0 / count(*), 4) AS success_rate FROM {LOG} WHERE {WINDOW}""")
def _(spark, sf):
    return rounded(LO.query_performance(query_log(spark, sf), AS_OF, WEEK))


@query("met02_learning_metrics", f"SELECT count(*) AS events, count(*) FILTER (pattern_updated) AS patterns_updated FROM {LOG} WHERE {WINDOW}")
def _(spark, sf):
    return LO.learning_metrics(query_log(spark, sf), AS_OF, WEEK)


@query("met02_intents", f"SELECT intent, count(*) AS count FROM {LOG} WHERE {WINDOW} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(spark, sf):
    return LO.intent_distribution(query_log(spark, sf), AS_OF, WEEK, top=3)


@query("met03_pattern_metrics", f"""
SELECT count(*) FILTER (pattern_updated) AS evolution_events, count(*) AS feedback_count, round(avg(user_satisfaction), 4) AS avg_rating FROM {LOG} WHERE {WINDOW}""")
def _(spark, sf):
    log = query_log(spark, sf)
    return rounded(LO.pattern_metrics(log.where("pattern_updated"), log.withColumn("rating", F.col("user_satisfaction")), AS_OF, WEEK))


@query("met04_running_totals", f"""
SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, round(count(*) FILTER (success) * 100.0 / count(*), 4) AS success_rate FROM {LOG}""")
def _(spark, sf):
    return rounded(LO.running_totals(query_log(spark, sf)))


@query("met05_query_alerts", f"""
SELECT event_id, CASE WHEN duration > 5 THEN 'CRITICAL' ELSE 'WARNING' END AS level, CASE WHEN duration > 5 THEN 'Query performance critical' ELSE 'Query performance slow' END AS title
FROM {LOG} WHERE duration > 2""")
def _(spark, sf):
    return LO.query_alerts(query_log(spark, sf)).select("event_id", "level", "title")


@query("met05_resource_alerts", f"""
WITH s AS (SELECT event_id, duration * 10 AS cpu, 100 - duration * 5 AS mem FROM {LOG})
SELECT event_id, CASE WHEN cpu > 85 THEN 'CRITICAL' ELSE 'WARNING' END AS level, CASE WHEN cpu > 85 THEN 'CPU usage critical' ELSE 'CPU usage high' END AS title FROM s WHERE cpu > 70
UNION ALL SELECT event_id, CASE WHEN mem > 90 THEN 'CRITICAL' ELSE 'WARNING' END, CASE WHEN mem > 90 THEN 'Memory usage critical' ELSE 'Memory usage high' END FROM s WHERE mem > 80""")
def _(spark, sf):
    samples = query_log(spark, sf).select("event_id", (F.col("duration") * 10).alias("cpu_percent"), (100 - F.col("duration") * 5).alias("memory_percent"))
    return LO.resource_alerts(samples).select("event_id", "level", "title")


@query("met05_health", f"""
SELECT event_id, CASE WHEN duration * 10 > 85 OR 100 - duration * 5 > 90 THEN 'CRITICAL' WHEN duration * 10 > 70 OR 100 - duration * 5 > 80 THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM {LOG}""")
def _(spark, sf):
    return query_log(spark, sf).select("event_id", LO.health(F.col("duration") * 10, 100 - F.col("duration") * 5).alias("status"))


# --- learning ----------------------------------------------------------------------------------------

def _learning(spark, sf):
    return query_log(spark, sf).select(
        "collection_name", F.col("intent").alias("detected_intent"), F.col("props").alias("user_query"), "user_satisfaction", F.col("ts").alias("created_at"), "event_id"
    )


_PERFORMANCE = f"""SELECT collection_name, intent AS detected_intent, count(*) AS count, count(user_satisfaction) AS rated, coalesce(avg(user_satisfaction), 0) AS avg_satisfaction,
  count(*) FILTER (user_satisfaction >= 4) * 1.0 / count(*) AS success_rate FROM {LOG} GROUP BY 1, 2"""
# Patterns: one per user parity and event type, taken from part-of-day usage in the log.
_PATTERNS = f"""(SELECT collection_name, intent AS answer_intent, 'how to ' || intent AS question_pattern, min(duration) AS confidence_score, CAST(NULL AS DOUBLE) AS success_rate,
  count(*) FILTER (success) AS usage_count, count(*) % 2 = 0 AS is_active, CAST(TIMESTAMP '2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at FROM {LOG} WHERE intent <> 'view' GROUP BY 1, 2
  UNION ALL SELECT DISTINCT collection_name, 'unseen', 'never asked', 0.5, 0.5, 0, true, CAST(TIMESTAMP '2024-01-01 00:00:00' AS TIMESTAMP) FROM {LOG})"""


def _patterns(spark, sf):
    log = query_log(spark, sf)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    seen = log.where("intent <> 'view'").groupBy("collection_name", F.col("intent").alias("answer_intent")).agg(
        F.concat(F.lit("how to "), F.any_value("intent")).alias("question_pattern"), F.min("duration").alias("confidence_score"),
        F.lit(None).cast("double").alias("success_rate"), F.count_if("success").alias("usage_count"), (F.count(F.lit(1)) % 2 == 0).alias("is_active"), start.alias("updated_at"),
    )
    unseen = log.select("collection_name").distinct().select(
        "collection_name", F.lit("unseen").alias("answer_intent"), F.lit("never asked").alias("question_pattern"), F.lit(0.5).alias("confidence_score"),
        F.lit(0.5).alias("success_rate"), F.lit(0).cast("long").alias("usage_count"), F.lit(True).alias("is_active"), start.alias("updated_at"),
    )
    return seen.unionByName(unseen)


@query("lrn01_intent_performance", f"SELECT collection_name, detected_intent, count, rated, round(avg_satisfaction, 4) AS avg_satisfaction, round(success_rate, 4) AS success_rate FROM ({_PERFORMANCE})")
def _(spark, sf):
    return rounded(LE.intent_performance(_learning(spark, sf)))


@query("lrn02_evolve_patterns", f"""
WITH f AS ({_PERFORMANCE}), n AS (SELECT collection_name FROM {LOG} GROUP BY 1 HAVING count(*) >= 10)
SELECT p.collection_name, p.answer_intent, round(coalesce(f.avg_satisfaction / 5, p.confidence_score), 4) AS confidence_score, round(coalesce(f.success_rate, p.success_rate), 4) AS success_rate,
  strftime(CASE WHEN f.count IS NULL THEN p.updated_at ELSE TIMESTAMP '{AS_OF}' END, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM {_PATTERNS} p LEFT JOIN (SELECT * FROM f WHERE count >= 5 AND rated > 0 AND collection_name IN (SELECT collection_name FROM n)) f
  ON f.collection_name = p.collection_name AND f.detected_intent = p.answer_intent""")
def _(spark, sf):
    evolved = LE.evolve_patterns(_patterns(spark, sf), _learning(spark, sf), F.lit(AS_OF).cast("timestamp"))
    return rounded(evolved.select("collection_name", "answer_intent", "confidence_score", "success_rate", "updated_at"))


@query("lrn03_pattern_analytics", f"""
SELECT collection_name, count(*) AS total_patterns, count(*) FILTER (is_active) AS active_patterns, CAST(sum(usage_count) AS BIGINT) AS total_usage,
  round(avg(coalesce(confidence_score, 0)), 4) AS avg_confidence, round(avg(coalesce(success_rate, 0)), 4) AS avg_success_rate FROM {_PATTERNS} p GROUP BY 1""")
def _(spark, sf):
    return rounded(LE.pattern_analytics(_patterns(spark, sf)))


@query("lrn03_pattern_intents", f"SELECT collection_name, answer_intent, count(*) AS count FROM {_PATTERNS} p GROUP BY 1, 2")
def _(spark, sf):
    return LE.pattern_intents(_patterns(spark, sf))


@query("lrn03_recent_feedback", f"SELECT event_id FROM {LOG} WHERE collection_name = 'connections' ORDER BY ts DESC, event_id LIMIT 5")
def _(spark, sf):
    return LE.recent_feedback(_learning(spark, sf), "connections", "event_id").select("event_id")


@query("flt17_active_patterns", f"SELECT answer_intent, round(confidence_score, 4) AS confidence_score FROM {_PATTERNS} p WHERE is_active AND collection_name = 'connections'")
def _(spark, sf):
    from emberlake.operators.filters import active_patterns

    return rounded(active_patterns(_patterns(spark, sf), "connections").select("answer_intent", "confidence_score"))


@query("lrn04_add_usage", f"""
SELECT p.collection_name, p.answer_intent, p.usage_count + coalesce(u.uses, 0) AS usage_count, strftime(coalesce(u.last_used, p.updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM {_PATTERNS} p LEFT JOIN (SELECT collection_name, intent, count(*) AS uses, max(ts) AS last_used FROM {LOG} GROUP BY 1, 2) u ON u.collection_name = p.collection_name AND u.intent = p.answer_intent""")
def _(spark, sf):
    return rounded(LE.add_usage(_patterns(spark, sf), LE.usage_counts(_learning(spark, sf))).select("collection_name", "answer_intent", "usage_count", "updated_at"))


@query("lrn05_learning_rows", f"""
SELECT event_id, len(string_split(props, ' ')) AS word_count, regexp_matches(props, '\\d') AS has_numbers, 'session_' || strftime(ts, '%Y%m%d_%H%M%S') AS session_id FROM {LOG}""")
def _(spark, sf):
    rows = LE.learning_rows(_learning(spark, sf))
    return rounded(rows.select("event_id", F.col("query_features.word_count").alias("word_count"), F.col("query_features.has_numbers").alias("has_numbers"), "session_id"))
