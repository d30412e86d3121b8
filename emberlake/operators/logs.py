"""Event logs and query metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake import spec as S
from emberlake.operators.combine import newest_per_key
from emberlake.operators.filters import matching_values
from emberlake.operators.vector import nearest, with_payload

DIMENSIONS = ("event_type", "log_level", "component", "user_id")


def logs_summary(logs: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """``dimension, value, count`` over all rows; a missing value counts as ``unknown``.

    Grouping sets read the log once and shuffle only partial counts.
    """
    filled = logs.select(*[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dimensions])
    grouped = filled.groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.grouping_id(*dimensions).alias("__g"), F.count(F.lit(1)).alias("count")
    )
    names, last = F.lit(None).cast("string"), len(dimensions) - 1
    full = (1 << len(dimensions)) - 1
    dimension = F.coalesce(*[F.when(F.col("__g") == full - (1 << (last - i)), F.lit(d)) for i, d in enumerate(dimensions)], names)
    return grouped.select(dimension.alias("dimension"), F.coalesce(*dimensions).alias("value"), "count")


def logs_totals(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_distinct(F.coalesce(F.col("user_id").cast("string"), F.lit("unknown"))).alias("active_users"),
    )


def top_users(logs: DataFrame, limit: int = 10) -> DataFrame:
    user = F.coalesce(F.col("user_id").cast("string"), F.lit("unknown")).alias("user_id")
    return logs.groupBy(user).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "user_id").limit(limit)


def errors_by(logs: DataFrame) -> DataFrame:
    """Error rows counted by component and by event type."""
    return logs_summary(logs.where(F.lower("log_level") == "error"), ("component", "event_type"))


def duration_stats(logs: DataFrame, duration: str = "duration") -> DataFrame:
    """Overall and per operation and component: count, mean, maximum and minimum duration."""
    rows = logs.where(F.col(duration).isNotNull())
    return rows.groupingSets([[], ["operation", "component"]], "operation", "component").agg(
        F.grouping("operation").cast("int").alias("overall"), F.count(F.lit(1)).alias("count"),
        F.avg(duration).alias("avg_duration"), F.max(duration).alias("max_duration"), F.min(duration).alias("min_duration"),
    )


def duration_histogram(logs: DataFrame, low: float, high: float, buckets: int, duration: str = "duration") -> DataFrame:
    bucket = F.width_bucket(F.col(duration), F.lit(float(low)), F.lit(float(high)), F.lit(buckets))
    return logs.where(F.col(duration).isNotNull()).groupBy("component", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def user_activity(logs: DataFrame, user: Any, moment: str = "ts", limit: int | None = None, tie: str = "event_id") -> DataFrame:
    rows = logs.where(F.col("user_id") == F.lit(user)).orderBy(F.desc(moment), tie)
    return rows if limit is None else rows.limit(limit)


def search_logs(
    logs: DataFrame, vector: Sequence[float], filters: Mapping[str, Any] | None = None, limit: int = 50, *,
    id_column: str = "event_id", vector_column: str = "embedding",
) -> DataFrame:
    """Logs nearest to a query vector among those that pass the filters."""
    pool = matching_values(logs, filters or {})
    hits = nearest(pool, vector, limit, id_column=id_column, vector_column=vector_column)
    return with_payload(hits, logs, id_column, [c for c in logs.columns if c != vector_column])


# --- event constructors: raw rows to the event schema ----------------------------------------------

def _event(df: DataFrame, event_type: str, level: Column, component: Column, message: Column, details: Column,
           error_info: Column | None = None, performance: Column | None = None) -> DataFrame:
    empty = F.lit(None).cast("map<string,string>")
    return df.select(
        *[c for c in ("event_id", "ts", "user_id", "session_id") if c in df.columns],
        F.lit(event_type).alias("event_type"), level.alias("log_level"), component.alias("component"),
        message.alias("message"), details.cast("map<string,string>").alias("details"),
        (error_info if error_info is not None else empty).alias("error_info"),
        (performance if performance is not None else empty).alias("performance_metrics"),
    ).withColumn("search_text", F.concat_ws(" ", "event_type", "log_level", "component", "message"))


def _map(**items: Column) -> Column:
    """A text map; entries with a null value are left out."""
    pairs = F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in items.items()
    ]))
    return F.map_from_entries(pairs)


def error_events(df: DataFrame) -> DataFrame:
    """From ``component, error_type, error_message, user_message``."""
    message = F.coalesce(F.when(F.col("user_message") != "", F.col("user_message")), F.col("error_message"))
    info = _map(error_type=F.col("error_type"), error_message=F.col("error_message"), user_message=F.col("user_message"))
    return _event(df, "error", F.lit("error"), F.col("component"), message, F.create_map().cast("map<string,string>"), info)


def question_events(df: DataFrame) -> DataFrame:
    """From ``question, tables, engine``."""
    q = F.col("question")
    message = F.concat(F.lit("RAG query: "), F.left(q, F.lit(100)), F.when(F.length(q) > 100, F.lit("...")).otherwise(F.lit("")))
    details = _map(question=q, selected_tables=F.col("tables"), vector_search_engine=F.col("engine"), question_length=F.length(q))
    return _event(df, "rag_query", F.lit("info"), F.lit("RAG_QA"), message, details)


def sql_events(df: DataFrame) -> DataFrame:
    """From ``sql_query, execution_time, row_count``; zero values are left out of the metrics."""
    rows, seconds = F.col("row_count"), F.col("execution_time")
    message = F.concat(F.lit("SQL query executed: "), F.coalesce(rows.cast("string"), F.lit("None")), F.lit(" rows returned"))
    metrics = _map(execution_time_seconds=F.when(seconds != 0, seconds), row_count=F.when(rows != 0, rows))
    details = _map(sql_query=F.col("sql_query"), query_length=F.length("sql_query"))
    return _event(df, "sql_query", F.lit("info"), F.lit("SQL_Editor"), message, details, performance=metrics)


def login_events(df: DataFrame) -> DataFrame:
    """From ``auth_method, success, error_message``."""
    ok = F.col("success")
    message = F.concat(F.lit("Authentication "), F.when(ok, "successful").otherwise("failed"), F.lit(" via "), F.col("auth_method"))
    info = F.when(~ok & F.col("error_message").isNotNull(), _map(error_message=F.col("error_message")))
    details = _map(auth_method=F.col("auth_method"), success=ok)
    return _event(df, "authentication", F.when(ok, "info").otherwise("error"), F.lit("Authentication"), message, details, info)


def code_events(df: DataFrame) -> DataFrame:
    """From ``question, generated_code, provider, success, error_message``."""
    ok = F.col("success")
    message = F.concat(F.lit("Code generation "), F.when(ok, "successful").otherwise("failed"), F.lit(" with "), F.col("provider"))
    info = F.when(~ok & F.col("error_message").isNotNull(), _map(execution_error=F.col("error_message")))
    details = _map(
        question=F.col("question"), generated_code=F.col("generated_code"), llm_provider=F.col("provider"),
        code_length=F.length("generated_code"), execution_success=ok,
    )
    return _event(df, "code_generation", F.when(ok, "info").otherwise("error"), F.lit("Code_Generation"), message, details, info)


def performance_events(df: DataFrame) -> DataFrame:
    """From ``component, operation, duration``."""
    message = F.concat(F.lit("Performance: "), F.col("operation"), F.format_string(" took %.2fs", F.col("duration")))
    metrics = _map(duration_seconds=F.col("duration"), operation=F.col("operation"))
    return _event(df, "performance", F.lit("info"), F.col("component"), message, F.create_map().cast("map<string,string>"), performance=metrics)


# --- query metrics ----------------------------------------------------------------------------------

def since(df: DataFrame, as_of: Any, minutes: int, moment: str = "ts") -> DataFrame:
    """Rows after the start of a look-back window that ends at ``as_of``."""
    end = F.lit(as_of).cast("timestamp")
    at = F.col(moment).cast("timestamp")
    return df.where((at > end - F.expr(f"INTERVAL {int(minutes)} MINUTES")) & (at <= end))


def success_percent(ok: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(ok) * 100.0, F.count(F.lit(1))), F.lit(0.0))


def performance_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"), F.coalesce(F.avg("duration"), F.lit(0.0)).alias("avg_duration"),
        F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"),
        success_percent(F.col("success")).alias("success_rate"),
    ]


def query_performance(queries: DataFrame, as_of: Any, minutes: int = 60) -> DataFrame:
    return since(queries, as_of, minutes).agg(*performance_aggregates())


def learning_metrics(events: DataFrame, as_of: Any, minutes: int = 60) -> DataFrame:
    return since(events, as_of, minutes).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("pattern_updated").alias("patterns_updated")
    )


def intent_distribution(events: DataFrame, as_of: Any, minutes: int = 60, top: int | None = None) -> DataFrame:
    counts = since(events, as_of, minutes).groupBy("intent").agg(F.count(F.lit(1)).alias("count"))
    return counts if top is None else counts.orderBy(F.desc("count"), "intent").limit(top)


def pattern_metrics(evolution: DataFrame, feedback: DataFrame, as_of: Any, minutes: int = 60) -> DataFrame:
    """Evolution events, feedback count and mean rating of the rated feedback, in one pass per table."""
    a = since(evolution, as_of, minutes).select(F.lit(1).alias("e"), F.lit(0).alias("f"), F.lit(None).cast("double").alias("rating"))
    b = since(feedback, as_of, minutes).select(F.lit(0).alias("e"), F.lit(1).alias("f"), F.col("rating").cast("double").alias("rating"))
    return a.unionByName(b).agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("evolution_events"), F.coalesce(F.sum("f"), F.lit(0)).alias("feedback_count"),
        F.coalesce(F.avg("rating"), F.lit(0.0)).alias("avg_rating"),
    )


def running_totals(queries: DataFrame) -> DataFrame:
    return queries.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        success_percent(F.col("success")).alias("success_rate"),
    )


def level_of(value: Column, warning: float, critical: float) -> Column:
    return F.when(value > critical, "CRITICAL").when(value > warning, "WARNING")


def query_alerts(queries: DataFrame) -> DataFrame:
    """One alert row per slow query."""
    level = level_of(F.col("duration"), S.QUERY_SECONDS_WARNING, S.QUERY_SECONDS_CRITICAL)
    return queries.withColumn("level", level).where(F.col("level").isNotNull()).withColumns({
        "title": F.when(F.col("level") == "CRITICAL", "Query performance critical").otherwise("Query performance slow"),
        "message": F.format_string("Query took %.2fs", F.col("duration")),
    })


def resource_alerts(samples: DataFrame) -> DataFrame:
    """CPU and memory alerts, one row each, from ``ts, cpu_percent, memory_percent`` samples."""
    def alert(name: str, column: str, warning: float, critical: float) -> Column:
        level = level_of(F.col(column), warning, critical)
        return F.when(level.isNotNull(), F.struct(
            level.alias("level"),
            F.concat(F.lit(f"{name} usage "), F.when(level == "CRITICAL", "critical").otherwise("high")).alias("title"),
            F.format_string(f"{name}: %.1f%%", F.col(column)).alias("message"),
        ))

    found = F.array_compact(F.array(
        alert("CPU", "cpu_percent", S.CPU_WARNING, S.CPU_CRITICAL),
        alert("Memory", "memory_percent", S.MEMORY_WARNING, S.MEMORY_CRITICAL),
    ))
    return samples.select("*", F.explode(found).alias("alert")).select(*samples.columns, "alert.*")


def health(cpu: Column, memory: Column) -> Column:
    critical = (cpu > S.CPU_CRITICAL) | (memory > S.MEMORY_CRITICAL)
    warning = (cpu > S.CPU_WARNING) | (memory > S.MEMORY_WARNING)
    return F.when(critical, "CRITICAL").when(warning, "WARNING").otherwise("HEALTHY")


def last_samples(samples: DataFrame, metric: str = "metric", moment: str = "ts", tie: str = "event_id", keep: int = 1000) -> DataFrame:
    """The newest ``keep`` rows of every metric."""
    return newest_per_key(samples, [metric], [F.desc(moment), F.desc(tie)], keep)
