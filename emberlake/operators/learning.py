"""Learning from answered questions: intent performance, pattern confidence, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.combine import refresh_from
from emberlake.operators.limits import newest
from emberlake.operators.questions import query_features

# Least rows before patterns change, least rows per intent, rating that counts as success.
MIN_LEARNING_ROWS, MIN_INTENT_ROWS, GOOD_RATING, MAX_RATING = 10, 5, 4, 5.0


def intent_performance(learning: DataFrame) -> DataFrame:
    """Per collection and intent: rows, mean rating of rated rows, good ratings over all rows."""
    rating = F.col("user_satisfaction")
    rows = learning.where(F.col("detected_intent").isNotNull() & (F.col("detected_intent") != ""))
    return rows.groupBy("collection_name", "detected_intent").agg(
        F.count(F.lit(1)).alias("count"), F.count(rating).alias("rated"),
        F.coalesce(F.avg(rating), F.lit(0.0)).alias("avg_satisfaction"),
        (F.count_if(rating >= GOOD_RATING) / F.count(F.lit(1))).alias("success_rate"),
    )


def evolve_patterns(patterns: DataFrame, learning: DataFrame, as_of: Column, keep_unrated: bool = True) -> DataFrame:
    """Patterns with confidence and success rate from their intent's performance.

    Collections with fewer than ten learning rows, and intents with fewer than five, stay as they are.
    ``keep_unrated=False`` lets an intent without any rating drop to zero.
    """
    enough = learning.groupBy("collection_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_LEARNING_ROWS)
    performance = intent_performance(learning).where(F.col("count") >= MIN_INTENT_ROWS)
    if keep_unrated:
        performance = performance.where("rated > 0")
    fresh = performance.join(enough, "collection_name", "left_semi").select(
        "collection_name", F.col("detected_intent").alias("answer_intent"),
        (F.col("avg_satisfaction") / MAX_RATING).alias("confidence_score"), "success_rate", as_of.alias("updated_at"),
    )
    return refresh_from(patterns, fresh, ["collection_name", "answer_intent"], ["confidence_score", "success_rate", "updated_at"])


def pattern_analytics(patterns: DataFrame) -> DataFrame:
    """Per collection: totals, active patterns, usage, mean confidence and success (missing counts as 0)."""
    return patterns.groupBy("collection_name").agg(
        F.count(F.lit(1)).alias("total_patterns"), F.count_if(F.coalesce("is_active", F.lit(False))).alias("active_patterns"),
        F.coalesce(F.sum("usage_count"), F.lit(0)).alias("total_usage"),
        F.avg(F.coalesce("confidence_score", F.lit(0.0))).alias("avg_confidence"),
        F.avg(F.coalesce("success_rate", F.lit(0.0))).alias("avg_success_rate"),
    )


def pattern_intents(patterns: DataFrame) -> DataFrame:
    intent = F.coalesce("answer_intent", F.lit("unknown")).alias("answer_intent")
    return patterns.groupBy("collection_name", intent).agg(F.count(F.lit(1)).alias("count"))


def recent_feedback(feedback: DataFrame, collection: str, tie: str, limit: int = 5) -> DataFrame:
    return newest(feedback.where(F.col("collection_name") == collection), "created_at", [tie], limit)


def usage_counts(learning: DataFrame) -> DataFrame:
    return learning.where(F.col("detected_intent").isNotNull()).groupBy(
        "collection_name", F.col("detected_intent").alias("answer_intent")
    ).agg(F.count(F.lit(1)).alias("uses"), F.max("created_at").alias("last_used"))


def add_usage(patterns: DataFrame, uses: DataFrame) -> DataFrame:
    """Patterns with usage counts raised by the ``uses`` rows and the time of last use."""
    joined = patterns.join(uses, ["collection_name", "answer_intent"], "left")
    return joined.withColumns({
        "usage_count": F.coalesce("usage_count", F.lit(0)) + F.coalesce("uses", F.lit(0)),
        "updated_at": F.coalesce("last_used", "updated_at"),
    }).select(*patterns.columns)


def learning_rows(questions: DataFrame) -> DataFrame:
    """``collection_name, user_query, detected_intent, created_at`` rows with their query features."""
    return questions.withColumns({
        "query_features": query_features(F.col("user_query")),
        "session_id": F.concat(F.lit("session_"), F.date_format("created_at", "yyyyMMdd_HHmmss")),
    })
