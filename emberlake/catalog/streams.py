"""INC and STR queries: each runs a stream over a whole table to its end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake.catalog.base import query, rounded, token_slots_sql
from emberlake.operators import incremental as I
from emberlake.operators.project import composite_id, labelled_text
from emberlake.operators.vector import embed_text
from emberlake.plans.stand_ins import QUERY_LOG_SQL, query_log_of
from emberlake.session import fresh_path
from emberlake.sources.published import read_published
from emberlake.sources.readers import table
from emberlake.streaming import jobs as J

LOG = f"{QUERY_LOG_SQL} q"


FILES = 4
ROWS_PER_FILE = 250_000


def _landed(spark, sf, name: str, by: str, heartbeat: dict | None = None):
    """A table as ``FILES`` loads that came in one after the other, cut at equal steps of ``by``; read as one batch each.

    A load is one file, a large one several; every load has as many, if need be empty ones, so that a batch never reaches into the
    next load. ``heartbeat`` adds a last file with a single row of these values, null elsewhere.
    """
    rows, path = table(spark, sf, name), fresh_path(spark, "landed")
    at = F.col(by).cast("timestamp").cast("double") if dict(rows.dtypes)[by].startswith("timestamp") else F.col(by).cast("double")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    step = F.least(F.floor((at - low) / max((high - low) / FILES, 1e-9)), F.lit(FILES - 1))
    largest = rows.where(step.isNotNull()).groupBy(step.alias("step")).count().agg(F.max("count")).first()[0]
    files = max(1, -(-largest // ROWS_PER_FILE))
    for k in range(FILES):
        load, folder = rows.where(step == k), f"{path}/load={k}.parquet"
        (load.coalesce(1) if files == 1 else load.repartition(files)).write.parquet(folder)
        for _ in range(files - len(spark.read.schema(rows.schema).parquet(folder).inputFiles()) if files > 1 else 0):
            rows.limit(0).coalesce(1).write.mode("append").parquet(folder)
    if heartbeat:
        last = rows.agg(*[F.coalesce(v, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c, v in heartbeat.items()])
        last.select(*[F.col(c) if c in heartbeat else F.lit(None).cast(f.dataType).alias(c) for c, f in zip(rows.columns, rows.schema)]).write.parquet(f"{path}/load={FILES}.parquet")
    return J.table_stream(spark, path, "load=*", rows.schema, files_per_batch=files)


def _log_stream(spark, sf, heartbeat: dict | None = None):
    return query_log_of(_landed(spark, sf, "events", "ts", heartbeat))


def _windows(df):
    # Means of few four-digit numbers: nine digits leave no ties to round.
    return rounded(df.withColumn("avg_duration", F.round("avg_duration", 9)), 4, keep="avg_")


def _stats(group: str) -> str:
    return f"""count(*) AS count, round(avg(duration), 9) AS avg_duration, round(min(duration), 4) AS min_duration, round(max(duration), 4) AS max_duration,
  round(count(*) FILTER (success) * 100.0 / count(*), 4) AS success_rate FROM {group}"""


_TUMBLING = f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
  {_stats(LOG)} GROUP BY 1, 2"""


def _closed_windows(spark, sf, *window: str):
    """Windows in append mode; a row a day after the last one closes them all."""
    path = fresh_path(spark, "windows")
    stream = _log_stream(spark, sf, {"ts": F.max("ts") + F.expr("INTERVAL 1 DAY")})
    J.append_closed(J.windowed_performance(stream, *window), f"{path}/result", f"{path}/checkpoint")
    return _windows(spark.read.parquet(f"{path}/result"))


@query("str02_windows_on_stream", _TUMBLING)
def _(spark, sf):
    return _closed_windows(spark, sf)


@query("str02_stream_batches", """
SELECT k AS batch, (SELECT count(*) FROM (SELECT least(floor((epoch(ts) - lo) / ((hi - lo) / 4)), 3) AS f FROM events, (SELECT min(epoch(ts)) AS lo, max(epoch(ts)) AS hi FROM events)) WHERE f = k) AS rows, 0::BIGINT AS late
FROM (SELECT unnest(range(4)) AS k)""")
def _(spark, sf):
    """Rows and late rows of each batch with data, as the stream reports them; the state is checked to have been given up."""
    path = fresh_path(spark, "windows")
    stream = _log_stream(spark, sf, {"ts": F.max("ts") + F.expr("INTERVAL 1 DAY")})
    batches = J.append_closed(J.windowed_performance(stream), f"{path}/result", f"{path}/checkpoint")
    if batches[-1]["state"] > 1:
        raise RuntimeError(f"windows are left in state: {batches}")
    rows = [(b["batch"], b["rows"], b["late"]) for b in batches if b["rows"] and b["batch"] < FILES]  # one row a batch
    return spark.createDataFrame(rows, "batch long, rows long, late long")


@query("str02_windows_on_table", _TUMBLING)
def _(spark, sf):
    return _windows(J.windowed_performance(query_log_of(table(spark, sf, "events"))))


@query("str02_sliding_windows", f"""
WITH w AS (SELECT *, unnest(generate_series(0, 11)) AS k FROM {LOG}),
x AS (SELECT *, to_timestamp(floor(epoch(ts) / 300) * 300 - k * 300) AT TIME ZONE 'UTC' AS start FROM w)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(start + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, {_stats("x")} GROUP BY 1, 2""")
def _(spark, sf):
    return _windows(J.windowed_performance(query_log_of(table(spark, sf, "events")), "1 hour", "5 minutes"))


@query("str01_event_ingest", f"SELECT event_id, log_level, component FROM {LOG}")
def _(spark, sf):
    path = fresh_path(spark, "ingest")
    J.append_to(_log_stream(spark, sf).select("event_id", "log_level", "component"), f"{path}/log", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/log")


@query("str03_alerts", f"SELECT event_id, CASE WHEN duration > 5 THEN 'CRITICAL' ELSE 'WARNING' END AS level FROM {LOG} WHERE duration > 2")
def _(spark, sf):
    path = fresh_path(spark, "alerts")
    J.append_to(J.alerts(_log_stream(spark, sf)).select("event_id", "level"), f"{path}/alerts", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/alerts")


@query("str04_counters", f"SELECT event_type, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM {LOG} GROUP BY 1")
def _(spark, sf):
    path = fresh_path(spark, "counters")
    J.merge_changes(J.counters(_log_stream(spark, sf), ["event_type"]), f"{path}/result", ["event_type"], f"{path}/checkpoint")
    return read_published(spark, f"{path}/result").drop("key")


@query("str06_usage", f"""
SELECT collection_name, intent AS answer_intent, count(*) + 1 AS usage_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM {LOG} GROUP BY 1, 2""")
def _(spark, sf):
    path = fresh_path(spark, "usage")
    learning = _log_stream(spark, sf).select("collection_name", F.col("intent").alias("detected_intent"), F.col("ts").alias("created_at"))
    J.merge_changes(J.usage_stream(learning), f"{path}/result", ["collection_name", "answer_intent"], f"{path}/checkpoint")
    uses = read_published(spark, f"{path}/result").drop("key")
    patterns = uses.select("collection_name", "answer_intent", F.lit(1).cast("long").alias("usage_count"), F.lit(None).cast("timestamp").alias("updated_at"))
    return rounded(J.apply_usage(patterns, uses))


def _stopped_load(spark, sf, path: str, **options) -> str:
    """The orders in batches: a first run is stopped after two, a second goes on, a third finds all done."""
    source = _landed(spark, sf, "orders", "o_orderkey")
    for most in (2, None, None):
        target = J.build_index(spark, source, f"{path}/orders", f"{path}/progress", "orders", id_column="o_orderkey", buckets=8, max_batches=most, **options)
    return target


@query("inc01_resumable_load", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def _(spark, sf):
    path = fresh_path(spark, "index")
    return rounded(read_published(spark, _stopped_load(spark, sf, path)).select("o_orderkey", "o_totalprice"), 2)


@query("inc01_batches", "SELECT unnest([0, 1, 2, 3, -1])::BIGINT AS offset, 1::BIGINT AS times")
def _(spark, sf):
    """The offsets that the stopped load has saved: each batch once, then the end mark."""
    path = fresh_path(spark, "index")
    _stopped_load(spark, sf, path)
    return spark.read.schema(J.PROGRESS_SCHEMA).parquet(f"{path}/progress").groupBy("offset").agg(F.count("*").alias("times"))


@query("inc02_progress", "SELECT 'orders' AS collection, -1 AS last, count(*) AS rows FROM orders")
def _(spark, sf):
    path = fresh_path(spark, "index")
    target = _stopped_load(spark, sf, path)
    J.reset_progress(spark, f"{path}/progress", "orders")
    source = _landed(spark, sf, "orders", "o_orderkey")
    target = J.build_index(spark, source, target, f"{path}/progress", "orders", id_column="o_orderkey", buckets=8, force=True)
    rows = read_published(spark, target).agg(F.count(F.lit(1))).scalar()
    return J.progress(spark, f"{path}/progress").select("collection", F.col("offset").alias("last"), rows.alias("rows"))


@query("inc03_used_ids", """
SELECT CAST(d.doc_id AS STRING) || '-' || d.lang AS row_key FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    docs = I.with_id(table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id", "lang"])
    first = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    path = fresh_path(spark, "tracker")
    I.tracker_rows(first, "documents", "raw").write.parquet(path)
    return I.new_rows(docs, spark.read.parquet(path), "documents", "raw").select("row_key")


@query("inc04_training_pairs", """
SELECT q.text AS text1, a.text AS text2, 1.0::DOUBLE AS label FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant' UNION ALL SELECT CAST(doc_id AS STRING), lang, 1.0 FROM documents""")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = I.training_pairs(asked.join(told, ["conv_id", "turn"]))
    return pairs.unionByName(I.training_pairs(table(spark, sf, "documents"), ("doc_id", "lang")))


@query("inc05_chunked_build", f"""
WITH lines AS (SELECT DISTINCT sha256(concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS id,
  concat_ws(' | ', 'Property type: ' || p_type, 'Bedrooms: ' || p_size, 'Address: ' || p_name) AS text FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
texts AS (SELECT DISTINCT text FROM lines), {token_slots_sql("texts", "text", "text", 32)},
v AS (SELECT key, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS w FROM slots)
SELECT id, text, vector FROM lines JOIN (SELECT key, string_agg(slot || '=' || CAST(round(w * 1000) AS BIGINT), ';' ORDER BY slot) AS vector FROM v GROUP BY key) ON key = text""")
def _(spark, sf):
    """Read, join, describe, encode and merge, batch by batch; ids are key hashes, unique across batches. One run is stopped half-way."""
    path = fresh_path(spark, "build")
    parts = table(spark, sf, "part")

    def prepare(batch):
        joined = batch.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        named = joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("p_type").alias("premise_type"), F.col("p_size").alias("bedroom_count"), F.col("p_name").alias("street_name"))
        described = labelled_text(named).withColumn("id", F.sha2(composite_id(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]), 256))
        return embed_text(described.select("id", "text"), "text", 32, "vector")

    source = _landed(spark, sf, "lineitem", "l_orderkey")
    for most in (2, None):
        target = J.build_index(spark, source, f"{path}/points", f"{path}/progress", "lines", id_column="id", prepare=prepare, max_batches=most)
    entries = F.transform("vector", lambda w, i: F.when(w != 0, F.struct(i.alias("slot"), F.round(w.cast("double") * 1000).cast("long").alias("w"))))
    entries = F.filter(entries, lambda e: e["w"] != 0)
    vector = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["slot"], e["w"])), ";")
    return read_published(spark, target).select("id", "text", vector.alias("vector"))
