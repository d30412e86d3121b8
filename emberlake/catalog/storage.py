"""SRC and SNK queries: each writes and reads whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberlake.catalog.base import query, rounded
from emberlake.operators import points as PO
from emberlake.plans.stand_ins import query_log
from emberlake.session import fresh_path
from emberlake.sources import published as PB
from emberlake.sources import readers as R
from emberlake.sources import writers as W
from emberlake.sources.readers import table
from emberlake.spec import TableSpec

EVENTS = TableSpec("events", date_column="ts")
CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMER_SQL = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("src01_run_sql", """
SELECT c_mktsegment, count(*) AS orders, round(avg(o_totalprice), 4) AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1""")
def _(spark, sf):
    R.register_tables(spark, sf, ["orders", "customer"])
    return rounded(R.run_sql(spark, """
        SELECT c_mktsegment, count(*) AS orders, avg(o_totalprice) AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_totalprice > :least GROUP BY c_mktsegment""", {"least": 100000}))


@query("src03_csv", CUSTOMER_SQL)
def _(spark, sf):
    path = fresh_path(spark, "csv")
    W.append_csv(table(spark, sf, "customer"), path)
    return rounded(R.read_csv(spark, path, CUSTOMER))


@query("src04_by_ending", CUSTOMER_SQL)
def _(spark, sf):
    path = fresh_path(spark, "any") + ".json"
    W.export_json(table(spark, sf, "customer"), path)
    return rounded(R.read_any(spark, path, CUSTOMER))


@query("src05_folder", CUSTOMER_SQL)
def _(spark, sf):
    path = fresh_path(spark, "folder")
    W.overwrite(table(spark, sf, "customer").repartition(4), path)
    return rounded(R.read_folder(spark, path))


@query("src06_lake_table", CUSTOMER_SQL)
def _(spark, sf):
    return rounded(R.read_lake_table(spark, f"{sf}/customer.parquet"))


@query("src06_catalog_table", f"SELECT * FROM ({CUSTOMER_SQL}) UNION ALL (SELECT * FROM ({CUSTOMER_SQL}) ORDER BY c_acctbal DESC, c_custkey LIMIT 25)")
def _(spark, sf):
    """A table of the session's catalog by its name, whole, and its first rows in an order."""
    name = f"customers_{uuid.uuid4().hex}"
    table(spark, sf, "customer").createTempView(name)
    first = R.read_lake_table(spark, name, limit=25, order=[F.desc("c_acctbal"), "c_custkey"])
    return rounded(R.read_lake_table(spark, name).unionByName(first))


@query("src08_documents", "SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn("_id", F.col("doc_id")).select("_id", "doc_id", "lang").orderBy("doc_id")
    return R.read_documents(docs, F.col("lang") == "fr")


@query("src09_response_items", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def _(spark, sf):
    # One landed response per nation.
    item = F.struct(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    pages = table(spark, sf, "nation").select(F.struct(F.struct(F.array(item).alias("items")).alias("nations")).alias("data"))
    path = fresh_path(spark, "pages")
    W.export_json(pages, path)
    landed = spark.read.schema("data struct<nations: struct<items: array<struct<id: long, name: string>>>>").json(path)
    return R.response_items(landed, "nations")


@query("src10_all_points", "SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS size, CAST(label AS BIGINT) AS label FROM embeddings")
def _(spark, sf):
    points = PO.as_points(table(spark, sf, "embeddings"), "vec_id")
    return rounded(points.select("id", F.size("vector").alias("size"), F.col("payload.label").alias("label")))


@query("src11_try_json", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'not json ' || props ELSE replace(props, ': ', ':') END AS payload FROM events""")
def _(spark, sf):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("not json "), "props")).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", R.try_json(text).alias("payload"))


@query("src13_preview", "SELECT event_id, event_type FROM events WHERE ts BETWEEN '2024-01-05' AND '2024-01-20' ORDER BY event_id LIMIT 1000")
def _(spark, sf):
    return R.preview(table(spark, sf, "events"), EVENTS, ("2024-01-05", "2024-01-20"), ["event_id"]).select("event_id", "event_type")


# --- sinks -------------------------------------------------------------------------------------------

@query("snk01_append_csv", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, sf):
    path = fresh_path(spark, "append")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    W.append_csv(orders.where(urgent), path)
    W.append_csv(orders.where(~urgent), path)
    return R.read_csv(spark, path, "o_orderkey long, o_orderpriority string")


@query("snk02_by_table", "SELECT lang, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def _(spark, sf):
    path = fresh_path(spark, "tables")
    W.write_tables(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), path, "lang")
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"))


@query("snk03_merge_schema", "SELECT doc_id, lang, NULL AS source FROM documents UNION ALL SELECT doc_id, NULL, source FROM documents")
def _(spark, sf):
    path, docs = fresh_path(spark, "merge"), table(spark, sf, "documents")
    W.append_merging(docs.select("doc_id", "lang"), path)
    W.append_merging(docs.select("doc_id", "source"), path)
    return W.read_merged(spark, path)


_UPSERT = """
WITH n AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem)
SELECT o.o_orderkey AS id, round(coalesce(n.l_quantity, o.o_totalprice), 4) AS value, CASE WHEN n.l_orderkey IS NULL THEN 'old' ELSE 'new' END AS origin
FROM orders o LEFT JOIN n ON n.l_orderkey = o.o_orderkey AND n.r = 1
UNION ALL SELECT n.l_orderkey, round(n.l_quantity, 4), 'new' FROM n WHERE n.r = 1 AND n.l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""


@query("snk04_upsert", _UPSERT)
def _(spark, sf):
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.lit("old").alias("origin"),
                                            F.lit(None).cast("timestamp").alias("at"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    new = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("value"), F.lit("new").alias("origin"),
                                              F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    path = fresh_path(spark, "points")
    PB.create_published(spark, path, old.schema, "id", buckets=8)
    PB.upsert_published(path, old)
    PB.upsert_published(path, new, [F.desc(c) for c in ("at", "line", "a", "b")])
    return rounded(PB.read_published(spark, path).select("id", "value", "origin"))


@query("snk04_partial_upsert", """
SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'new' ELSE 'old' END AS origin, count(*) OVER () AS rows FROM orders""")
def _(spark, sf):
    """A second batch replaces some orders and is sent twice; a reader of the old version still sees the old rows."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    path = fresh_path(spark, "points")
    PB.create_published(spark, path, orders.select("id", F.lit("old").alias("origin")).schema, "id", buckets=8)
    PB.upsert_published(path, orders.select("id", F.lit("old").alias("origin")), source="orders", batch=0)
    before = PB.read_published(spark, path)
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("id", F.lit("new").alias("origin"))
    versions = {PB.upsert_published(path, urgent, source="orders", batch=1) for _ in range(2)}
    if len(versions) > 1:
        raise RuntimeError("a repeated batch made a version of its own")
    rows = before.where("origin = 'old'").agg(F.count("*")).scalar()
    return PB.read_published(spark, path).select("id", "origin", rows.alias("rows"))


@query("snk05_create_collection", "SELECT 64 AS vector_size, count(*) AS rows FROM embeddings")
def _(spark, sf):
    path = fresh_path(spark, "collection")
    size = W.create_collection(table(spark, sf, "embeddings"), path)
    return rounded(spark.read.parquet(path).agg(F.lit(size).alias("vector_size"), F.count(F.lit(1)).alias("rows")))


@query("snk06_insert_documents", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    path = fresh_path(spark, "inserted")
    W.insert_documents(table(spark, sf, "documents").select("doc_id", "text"), path)
    return spark.read.schema("doc_id long, text string").json(path)


@query("snk07_audit_row", "SELECT 'how many?' AS question, count(*) AS row_count, 5 AS column_count, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, false AS is_retry FROM customer")
def _(spark, sf):
    log = W.audit_row(table(spark, sf, "customer"), fresh_path(spark, "audit"), "how many?", "df.count()")
    return rounded(log.select("question", "row_count", "column_count", "columns", "is_retry"))


@query("snk08_export_metrics", "SELECT event_type, count(*) AS total FROM events GROUP BY 1")
def _(spark, sf):
    path = fresh_path(spark, "metrics")
    W.export_json(query_log(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("total")), path)
    return spark.read.schema("event_type string, total long").json(path)


@query("snk09_save_csv", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def _(spark, sf):
    path = fresh_path(spark, "result")
    W.save_csv(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path)
    return rounded(R.read_csv(spark, path, "id int, name string"))


@query("snk10_copy_collections", "SELECT lang, count(*) AS rows, true AS verified FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1")
def _(spark, sf):
    path = fresh_path(spark, "copy")
    points = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    verified = W.copy_collections(points, path, ["en", "fr"], column="lang")
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.lit(verified).alias("verified"))

