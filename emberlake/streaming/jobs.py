"""Structured Streaming: event ingest, windowed summaries, alerts, counters, resumable index builds."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from emberlake.operators.combine import newest_per_key
from emberlake.operators.learning import add_usage
from emberlake.operators.logs import performance_aggregates, query_alerts, resource_alerts
from emberlake.session import fresh_path
from emberlake.sources.published import create_published, exists, upsert_published


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table as a stream, whether it is one file or a folder of files.

    The bracket makes the path a pattern, which the file source accepts for both.
    """
    path = os.path.join(folder, f"[{name[0]}]{name[1:]}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _run(writer, checkpoint: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append it to Parquet, remember the position; run again to continue.

    The file sink writes a batch once even when an executor or the driver is lost in between.
    """
    return _run(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint)


def append_closed(results: DataFrame, path: str, checkpoint: str) -> list[dict[str, int]]:
    """Append each result of an event-time aggregation to Parquet once the watermark has passed it, and drop its state.

    Returns per batch the number of rows read, of groups in state afterwards, and of late rows that were left out (late rows of
    one task and group count once, as they are combined before they reach the state).
    """
    query = append_to(results, path, checkpoint)
    return [
        {"batch": p.batchId, "rows": p.numInputRows, "state": sum(s.numRowsTotal for s in p.stateOperators), "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)}
        for p in query.recentProgress
    ]


def merge_changes(counted: DataFrame, root: str, keys: Sequence[str], checkpoint: str, buckets: int = 4) -> StreamingQuery:
    """Keep a published collection at the newest value per key: each batch merges only the keys that it has changed.

    The collection has the columns of ``counted`` and ``key``, the keys as one text. A repeated batch is merged once.
    """
    spark = counted.sparkSession
    keyed = counted.withColumn("key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    if not exists(spark, root):
        create_published(spark, root, keyed.schema, "key", buckets)

    def merge(batch: DataFrame, number: int) -> None:
        upsert_published(root, batch, source=checkpoint, batch=number)

    return _run(keyed.writeStream.outputMode("update").foreachBatch(merge), checkpoint)


# --- summaries, alerts, counters --------------------------------------------------------------------

def windowed_performance(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Query metrics per window. Works on a stream, where rows later than ``delay`` are dropped, and on a table.

    On a stream, written by ``append_closed``, a window is given out once the newest row is ``delay`` past its end; a row that only
    carries a later time (no duration) moves the clock on when a source falls silent.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", delay)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(window.alias("w")).agg(*performance_aggregates()).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count", "avg_duration", "min_duration", "max_duration", "success_rate"
    )


def alerts(queries: DataFrame) -> DataFrame:
    """Stateless, so a stream of queries becomes a stream of alerts."""
    return query_alerts(queries)


def sample_alerts(samples: DataFrame) -> DataFrame:
    return resource_alerts(samples)


def notify(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call a handler with each batch of alerts, as a DataFrame."""
    return _run(stream.writeStream.foreachBatch(handler), checkpoint)


def counters(queries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running counts of all, successful and failed queries."""
    return queries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed")
    )


def usage_stream(learning: DataFrame) -> DataFrame:
    """Uses per collection and intent, to be added to the patterns by ``apply_usage``."""
    return learning.where(F.col("detected_intent").isNotNull()).groupBy(
        "collection_name", F.col("detected_intent").alias("answer_intent")
    ).agg(F.count(F.lit(1)).alias("uses"), F.max("created_at").alias("last_used"))


def apply_usage(patterns: DataFrame, counted: DataFrame) -> DataFrame:
    return add_usage(patterns, counted)


# --- resumable index builds -------------------------------------------------------------------------

PROGRESS_SCHEMA = "collection string, offset long, updated_at timestamp"


def note_progress(spark: SparkSession, path: str, collection: str, offset: int) -> None:
    """Append a progress row; -1 marks a finished collection."""
    spark.range(1).select(
        F.lit(collection).alias("collection"), F.lit(offset).cast("long").alias("offset"), F.current_timestamp().alias("updated_at")
    ).write.mode("append").parquet(path)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The newest progress row per collection."""
    rows = spark.read.schema(PROGRESS_SCHEMA).parquet(path)
    return newest_per_key(rows, ["collection"], [F.desc("updated_at")], 1)


def current_offset(spark: SparkSession, path: str, collection: str) -> int | None:
    try:
        row = progress(spark, path).where(F.col("collection") == collection).first()
    except AnalysisException as error:  # no progress written yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row is None else row.offset


class _Stopped(Exception):
    """A load has done as many batches as it was allowed to."""


def build_index(
    spark: SparkSession, source: DataFrame, target: str, progress_path: str, collection: str, *, id_column: str, force: bool = False,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df, order: Sequence[Column] = (), buckets: int = 16, max_batches: int | None = None,
) -> str:
    """Load a stream of rows into the published collection ``target``, continuing where the last run ended.

    Each batch is prepared, merged into the collection by id and noted in the progress table, in this order; readers
    see it from then on. A run that stops half-way, by ``max_batches`` or by a failure, loses nothing: its next run begins with the
    batch that was not finished, and one that had been merged already is recognised by its number. A finished
    collection is skipped. ``force`` starts a new collection beside the old one. Returns the collection's path.
    """
    done = current_offset(spark, progress_path, collection)
    if done == -1 and not force:
        return target
    version = f"{target}-{os.path.basename(fresh_path(spark, 'v'))}" if force else target
    finished = 0

    def write(batch: DataFrame, number: int) -> None:
        nonlocal finished
        if finished == max_batches:
            raise _Stopped(f"after {finished} batches")
        rows = prepare(batch)
        if not exists(spark, version):
            create_published(spark, version, rows.schema, id_column, buckets)
        upsert_published(version, rows, order, source=collection, batch=number)
        note_progress(spark, progress_path, collection, number)
        finished += 1

    try:
        _run(source.writeStream.foreachBatch(write), f"{version}.checkpoint")
    except StreamingQueryException:
        if finished != max_batches:
            raise
        return version
    note_progress(spark, progress_path, collection, -1)
    return version


def reset_progress(spark: SparkSession, path: str, collection: str) -> None:
    note_progress(spark, path, collection, 0)
