"""VEC queries and the filters that belong to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake.catalog.base import query, rounded, token_slots_sql
from emberlake.functions import vectors as VX
from emberlake.operators import vector as V
from emberlake.sources.readers import scan_vectors, table
from emberlake.spec import TableSpec

SIZE = 64
VECTOR = "CAST(embedding AS DOUBLE[])"
# The question: the stored vector of row 0.
QUESTION = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
COSINE = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-8)"


def _cosine(a: str = "v", b: str = "w") -> str:
    return f"round({COSINE.format(a=a, b=b)}, 9)"


_SCORED = f"s AS (SELECT vec_id, label, {_cosine()} AS score FROM (SELECT vec_id, label, {VECTOR} AS v, {QUESTION} AS w FROM embeddings))"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


def _question(spark, sf):
    return V.stored_vector(_vectors(spark, sf), "vec_id", 0)


@query("vec01_parse_embedding", f"SELECT vec_id, round(list_sum({VECTOR}), 6) AS total FROM embeddings")
def _(spark, sf):
    text = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), ", "), F.lit("]"))
    parsed = _vectors(spark, sf).select("vec_id", VX.parse_embedding(text).alias("v"))
    return rounded(parsed.select("vec_id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")), 6)


@query("vec02_nearest", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 100")
def _(spark, sf):
    return rounded(V.nearest(_vectors(spark, sf), _question(spark, sf), 100, id_column="vec_id"), 6)


@query("vec02_cosine_column", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM s")
def _(spark, sf):
    literal = VX.literal_vector(_question(spark, sf))
    return rounded(_vectors(spark, sf).select("vec_id", F.round(VX.cosine(F.col("embedding"), literal), 9).alias("score")), 6)


@query("vec03_nearest_l2", f"""
WITH s AS (SELECT vec_id, round(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM (SELECT vec_id, {VECTOR} AS v, {QUESTION} AS w FROM embeddings))
SELECT vec_id, round(distance, 6) AS distance FROM s ORDER BY s.distance, vec_id LIMIT 20""")
def _(spark, sf):
    hits = V.nearest(_vectors(spark, sf), _question(spark, sf), 20, id_column="vec_id", metric="l2")
    return rounded(hits.select("vec_id", F.abs("score").alias("distance")), 6)


@query("vec04_search", f"WITH {_SCORED} SELECT vec_id, CAST(label AS BIGINT) AS label, round(score, 6) AS score FROM s WHERE score >= 0.2 ORDER BY s.score DESC, vec_id LIMIT 25")
def _(spark, sf):
    return rounded(V.search(_vectors(spark, sf), _question(spark, sf), 25, id_column="vec_id", threshold=0.2, payload=["label"]), 6)


@query("vec05_filtered_search", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM s WHERE label = 2 AND score >= 0.01 ORDER BY s.score DESC, vec_id LIMIT 500")
def _(spark, sf):
    hits = V.search(_vectors(spark, sf), _question(spark, sf), 500, id_column="vec_id", threshold=0.01, where=F.col("label") == 2)
    return rounded(hits, 6)


# Flagship: filter vectors, rank, take the distinct keys, fetch the raw rows.
_HYBRID = f"""
WITH {_SCORED}, h AS (SELECT vec_id FROM s WHERE label <> 1 ORDER BY score DESC, vec_id LIMIT 100)
SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars > 200 AND doc_id IN (SELECT vec_id FROM h)"""


@query("vec06_hybrid", _HYBRID)
def vec06_hybrid(spark, sf):
    vectors = _vectors(spark, sf).withColumnRenamed("vec_id", "doc_id")
    found = V.hybrid_search(
        vectors, table(spark, sf, "documents"), _question(spark, sf), id_column="doc_id", keys=["doc_id"],
        where_vectors=F.col("label") != 1, where_raw=F.col("n_chars") > 200,
    )
    return found.select("doc_id", "lang", "source", "n_chars")


@query("vec06_hybrid_by_composite_key", f"""
WITH {_SCORED}, h AS (SELECT DISTINCT l.l_suppkey, l.l_returnflag FROM (SELECT vec_id FROM s ORDER BY score DESC, vec_id LIMIT 100) t
  JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1) l ON l.l_orderkey = t.vec_id)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_shipdate BETWEEN '1996-01-01' AND '1998-12-31' AND (l_suppkey, l_returnflag) IN (SELECT l_suppkey, l_returnflag FROM h)""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    keys = lines.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("l_returnflag"))
    vectors = _vectors(spark, sf).join(keys, F.col("vec_id") == F.col("l_orderkey"), "left").drop("l_orderkey")
    found = V.hybrid_search(
        vectors, lines, _question(spark, sf), id_column="vec_id", keys=["l_suppkey", "l_returnflag"],
        where_raw=F.col("l_shipdate").between("1996-01-01", "1998-12-31"),
    )
    return rounded(found.select("l_orderkey", "l_linenumber"))


@query("vec07_fallback_text", """
SELECT doc_id, 'text_search' AS source FROM documents WHERE regexp_matches(text, 'the of', 'i') ORDER BY doc_id LIMIT 20""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return V.first_nonempty_stage({
        "vector_search": lambda _: V.nearest(_vectors(spark, sf), _question(spark, sf), 20, id_column="vec_id", threshold=2.0).select(F.col("vec_id").alias("doc_id")),
        "text_search": lambda _: docs.where(F.col("text").rlike("(?i)the of")).select("doc_id").orderBy("doc_id").limit(20),
        "sample_fallback": lambda _: docs.select("doc_id").orderBy("doc_id").limit(20),
    })


# One query per label; its text stage finds the French documents of the source with the label's number.
@query("vec07_fallback_per_query", """
WITH l AS (SELECT DISTINCT label FROM embeddings),
t AS (SELECT l.label AS query_id, d.doc_id, row_number() OVER (PARTITION BY l.label ORDER BY d.doc_id) AS n FROM l JOIN documents d ON d.source = 'src' || l.label AND d.lang = 'fr')
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, 'text_search' AS source FROM t WHERE n <= 5
UNION ALL SELECT CAST(label AS BIGINT), -1, 'sample_fallback' FROM l WHERE label NOT IN (SELECT query_id FROM t)""")
def _(spark, sf):
    asked = _vectors(spark, sf).select(F.col("label").alias("query_id")).distinct()

    def text(left):
        named = left.withColumn("source", F.concat(F.lit("src"), F.col("query_id").cast("string")))
        french = table(spark, sf, "documents").where("lang = 'fr'").select("source", "doc_id").join(named.select("source"), "source", "left_semi")
        return named.join(V.newest_per_key(french, ["source"], [F.col("doc_id")], 5), "source").select("query_id", "doc_id")

    stages = {"text_search": text, "sample_fallback": lambda left: left.select("query_id", F.lit(-1).cast("long").alias("doc_id"))}
    return rounded(V.first_nonempty_stage(stages, asked, "query_id").select("query_id", "doc_id", "source"))


@query("vec08_embed_text", f"""
WITH {token_slots_sql("documents", "doc_id", "text", 64)}
SELECT key AS doc_id, slot, round((n / sqrt(sum(n * n) OVER (PARTITION BY key)))::FLOAT::DOUBLE, 4) AS weight FROM slots""")
def _(spark, sf):
    """The vectors of all documents, their entries other than zero as rows."""
    vectors = V.embed_text(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", F.posexplode("embedding").alias("slot", "weight"))
    return rounded(vectors.where("weight <> 0"))


@query("vec09_vector_sizes", "SELECT CAST(len(embedding) AS BIGINT) AS vector_size, count(*) AS count FROM embeddings GROUP BY 1")
def _(spark, sf):
    return rounded(V.vector_sizes(_vectors(spark, sf)))


_TERMS = ("licensed", "version", "apache", "idiot", "pathetic")


def _text_sql() -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(_TERMS))
    seen = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(_TERMS)))
    score = " + ".join(f"f{i} * CASE WHEN d{i} > 0 THEN ln(1 + n::DOUBLE / d{i}) ELSE 0 END" for i in range(len(_TERMS)))
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents), c AS (SELECT doc_id, {counts} FROM w),
s AS (SELECT count(*) AS n, {seen} FROM c), r AS (SELECT doc_id, round({score}, 6) AS score FROM c, s)
SELECT doc_id, score FROM r WHERE score > 0 ORDER BY r.score DESC, doc_id LIMIT 100"""


@query("vec11_text_search", _text_sql())
def _(spark, sf):
    return V.text_search(table(spark, sf, "documents"), "text", "The licensed version; of an Apache and this idiot was Pathetic", id_column="doc_id")


@query("vec12_several_tables", f"""
WITH {_SCORED}, a AS (SELECT vec_id, score, label FROM s WHERE label < 2 ORDER BY score DESC, vec_id LIMIT 5), b AS (SELECT vec_id, score, label FROM s WHERE label >= 2 ORDER BY score DESC, vec_id LIMIT 5)
SELECT vec_id, round(score, 6) AS score, 'low' AS _source_table FROM a UNION ALL SELECT vec_id, round(score, 6), 'high' FROM b""")
def _(spark, sf):
    v = _vectors(spark, sf)
    stacked = V.search_tables(
        {"low": v.where("label < 2"), "high": v.where("label >= 2")}, _question(spark, sf), id_columns={"low": "vec_id", "high": "vec_id"}, payload={},
    )
    return rounded(stacked.select(F.coalesce("vec_id_low", "vec_id_high").alias("vec_id"), F.coalesce("score_low", "score_high").alias("score"), "_source_table"), 6)


# A table of queries: the mean vector of every label.
_CENTRES = "(SELECT label, [" + ", ".join(f"round(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 6)" for i in range(SIZE)) + "] AS w FROM embeddings GROUP BY label)"
_MANY = f"""WITH p AS (SELECT c.label AS query_id, e.vec_id, {_cosine('e.v', 'c.w')} AS score FROM {_CENTRES} c, (SELECT vec_id, {VECTOR} AS v FROM embeddings) e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


def _centres(spark, sf):
    numbers = F.array(*[F.round(F.avg(F.col("embedding")[i].cast("double")), 6) for i in range(SIZE)])
    return _vectors(spark, sf).groupBy("label").agg(numbers.alias("embedding"))


@query("vec13_many_queries", _MANY)
def _(spark, sf):
    return rounded(V.nearest_many(_vectors(spark, sf), _centres(spark, sf), 10, id_column="vec_id", query_id="label"), 6)


@query("vec13_many_queries_in_blocks", _MANY)
def _(spark, sf):
    return rounded(V.nearest_many(_vectors(spark, sf), _centres(spark, sf), 10, id_column="vec_id", query_id="label", wave_numbers=4 * SIZE), 6)


@query("flt09_filter_before_ranking", f"WITH {_SCORED} SELECT vec_id FROM s WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def _(spark, sf):
    return V.nearest(_vectors(spark, sf).where("label = 3"), _question(spark, sf), 10, id_column="vec_id").select("vec_id")


@query("flt18_score_threshold", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.3 ORDER BY s.score DESC, vec_id LIMIT 50")
def _(spark, sf):
    return rounded(V.nearest(_vectors(spark, sf), _question(spark, sf), 50, id_column="vec_id", threshold=0.3), 6)


@query("src02_scan_vectors", "SELECT o_orderkey, o_orderdate_text FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate_text, o_orderdate FROM orders) WHERE o_orderdate BETWEEN '1997-01-01' AND '1997-03-31'")
def _(spark, sf):
    spec = TableSpec("orders", date_column="o_orderdate")
    rows = table(spark, sf, "orders").withColumn("embedding", F.array("o_totalprice"))
    scanned = scan_vectors(rows, spec, ["o_orderkey"], ("1997-01-01", "1997-03-31"))
    return scanned.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate_text"))
