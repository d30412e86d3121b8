"""JON and SET queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake.catalog.base import query, rounded
from emberlake.operators import combine as C
from emberlake.plans.stand_ins import CONNECTIONS_SQL, ORDER_MONTHS_SQL, connections, order_months
from emberlake.sources.readers import table
from emberlake.spec import CONNECTIONS


@query("jon01_raw_with_vectors", """
SELECT d.doc_id, d.lang, CAST(d.doc_id AS STRING) || '_' || d.lang AS unique_id, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_number
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""")
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    joined = C.raw_with_vectors(table(spark, sf, "documents").select("doc_id", "lang"), vectors, ["doc_id"], ["doc_id", "lang"])
    return rounded(joined.select("doc_id", "lang", "unique_id", F.col("embedding")[0].cast("double").alias("first_number")), 6)


@query("jon01_eight_keys", """
SELECT a.l_orderkey, CAST(a.l_linenumber AS BIGINT) AS l_linenumber, a.l_tax AS value FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber
AND a.l_quantity = b.l_quantity AND a.l_shipdate = b.l_shipdate AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus""")
def _(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus"]
    lines = table(spark, sf, "lineitem")
    vectors = lines.select(*keys, F.array("l_tax").alias("embedding"))
    joined = C.raw_with_vectors(lines.select(*keys), vectors, keys, keys[:3])
    return rounded(joined.select("l_orderkey", "l_linenumber", F.col("embedding")[0].alias("value")))


@query("jon02_link_join", """
SELECT d.doc_id, l.doc_id AS doc_id_link, CAST(l.quality AS BIGINT) AS quality_link FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(spark, sf):
    joined = C.link_join(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "doc_id")
    return rounded(joined.select("doc_id", "doc_id_link", "quality_link"))


@query("jon02_link_counts", """
SELECT count(DISTINCT d.doc_id) AS total_rows, count(DISTINCT d.doc_id) FILTER (l.doc_id IS NOT NULL) AS matched,
  count(DISTINCT d.doc_id) FILTER (l.doc_id IS NULL) AS unmatched, count(*) AS joined_rows
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(spark, sf):
    return C.link_join_counts(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "doc_id")


@query("jon03_inner_link", "SELECT l.doc_id AS doc_id_link, d.doc_id, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def _(spark, sf):
    joined = C.link_join(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "doc_id", "inner")
    return joined.select("doc_id_link", "doc_id", "source")


@query("jon04_related_join", """
SELECT o.o_orderkey, o.o_totalprice, o.note AS note_orders, c.note AS note_customer, c.c_name
FROM (SELECT *, o_orderstatus AS note FROM orders) o JOIN (SELECT *, c_mktsegment AS note FROM customer) c ON o.o_custkey = c.c_custkey""")
def _(spark, sf):
    frames = {
        "orders": table(spark, sf, "orders").withColumn("note", F.col("o_orderstatus")),
        "customer": table(spark, sf, "customer").withColumn("note", F.col("c_mktsegment")),
    }
    relations = [C.Relationship("orders", "customer", ("o_custkey",), ("c_custkey",)), C.Relationship("orders", "absent", ("a",), ("b",))]
    return C.combine_tables(frames, relations).select("o_orderkey", "o_totalprice", "note_orders", "note_customer", "c_name")


@query("jon06_unused_rows", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, sf):
    return C.unused_rows(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("jon07_small_side", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def _(spark, sf):
    # Spark broadcasts the supplier side by its measured size; beyond the threshold it shuffles.
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return rounded(joined.select("l_orderkey", "l_linenumber", "s_name"))


@query("jon09_refresh", """
SELECT c_custkey, CASE WHEN n.total IS NULL THEN c.c_acctbal ELSE n.total END AS c_acctbal
FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders GROUP BY 1) n ON n.o_custkey = c.c_custkey""")
def _(spark, sf):
    best = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return C.refresh_from(table(spark, sf, "customer"), best, ["c_custkey"], ["c_acctbal"]).select("c_custkey", "c_acctbal")


_TEXT_OF = {e.column: e.description for e in CONNECTIONS.dictionary}


@query("jon10_field_descriptions", f"""
SELECT _id, '{_TEXT_OF["POSTCODE"]}' AS postcode_text, '{_TEXT_OF["EMSN"]}' AS emsn_text, 6 AS described
FROM {CONNECTIONS_SQL} c""")
def _(spark, sf):
    described = C.describe_fields(connections(spark, sf), _TEXT_OF)
    column = F.col("_field_descriptions")
    return rounded(described.select(
        "_id", column["POSTCODE"].alias("postcode_text"), column["EMSN"].alias("emsn_text"), F.size(column).alias("described")
    ))


@query("set01_tagged_union", """
SELECT s_suppkey AS key, s_name AS name_supplier, NULL AS name_customer, 'supplier' AS _source_table, s_acctbal AS balance_supplier, CAST(NULL AS DOUBLE) AS balance_customer FROM supplier
UNION ALL SELECT c_custkey, NULL, c_name, 'customer', NULL, c_acctbal FROM customer""")
def _(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    stacked = C.tagged_union({
        "supplier": s.select("s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "customer": c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
    })
    return stacked.select(F.coalesce("s_suppkey", "c_custkey").alias("key"), "name_supplier", "name_customer", "_source_table", "balance_supplier", "balance_customer")


@query("set02_union_all", "SELECT p_type AS pattern FROM part UNION ALL SELECT c_mktsegment FROM customer")
def _(spark, sf):
    own = table(spark, sf, "part").select(F.col("p_type").alias("pattern"))
    return own.unionByName(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("pattern")))


@query("set03_all_used", "SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings")
def _(spark, sf):
    return C.all_used(table(spark, sf, "labels"), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query("set04_drop_duplicates", f"SELECT DISTINCT * FROM {ORDER_MONTHS_SQL} m")
def _(spark, sf):
    return C.without_duplicates(order_months(spark, sf))


@query("set05_duplicate_count", f"""
SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {ORDER_MONTHS_SQL} m)) AS duplicates FROM orders""")
def _(spark, sf):
    return C.duplicate_count(order_months(spark, sf))


@query("set06_duplicate_groups", f"SELECT meterNo, month, year, count(*) AS counts FROM {ORDER_MONTHS_SQL} m GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return C.duplicate_groups(order_months(spark, sf), ["meterNo", "month", "year"])
