"""Exact vector search, text embedding and text search."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.functions.vectors import ranking_task, read_queries
from emberlake.operators.combine import newest_per_key, tagged_union
from emberlake.operators.filters import scored_at_least
from emberlake.session import fresh_path, stage
from emberlake.spec import STOP_WORDS

# What a task holds of many queries at once: so many numbers of their vectors, so many hits.
WAVE_NUMBERS, WAVE_HITS = 4_000_000, 2_000_000


def vector_sizes(df: DataFrame, vector_column: str = "embedding") -> DataFrame:
    """Row count per vector size; a sound collection gives one row."""
    return df.groupBy(F.size(vector_column).alias("vector_size")).agg(F.count(F.lit(1)).alias("count"))


def vector_size(df: DataFrame, vector_column: str = "embedding") -> int:
    """The one size that all vectors share; anything else is an error."""
    bounds = df.agg(F.min(F.size(vector_column)).alias("a"), F.max(F.size(vector_column)).alias("b")).first()
    if bounds.a is None or bounds.a != bounds.b:
        raise ValueError(f"vector sizes range from {bounds.a} to {bounds.b}")
    return bounds.a


def stored_vector(df: DataFrame, id_column: str, value, vector_column: str = "embedding") -> list[float]:
    """The vector of one row: a key look-up that returns a single row."""
    row = df.where(F.col(id_column) == F.lit(value)).select(vector_column).first()
    if row is None:
        raise KeyError(value)
    return [float(x) for x in row[0]]


def nearest(
    df: DataFrame, vector: Sequence[float], n: int = 100, *, id_column: str, vector_column: str = "embedding",
    metric: str = "cosine", threshold: float | None = None,
) -> DataFrame:
    """``id, score`` of the ``n`` rows nearest to one vector; larger scores are nearer.

    ``score`` is the cosine, or with ``metric="l2"`` the negated squared distance. Each task ranks its
    rows with numpy and emits ``n`` of them; only those are sorted. Ties go to the smaller id.
    """
    queries = np.asarray([vector], dtype=np.float64)
    kind = df.schema[id_column].dataType.simpleString()
    task = ranking_task(id_column, vector_column, lambda: (pa.array([0], pa.int32()), queries), n, metric)
    ranked = df.select(id_column, vector_column).mapInArrow(task, f"query_id int, id {kind}, score double")
    kept = scored_at_least(ranked, threshold).orderBy(F.desc("score"), "id").limit(n)
    return kept.select(F.col("id").alias(id_column), "score")


def with_payload(hits: DataFrame, df: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """Hit rows with their payload. Ranking never reads the payload; this reads no vectors."""
    names = [c for c in columns if c != id_column]
    return hits.join(df.select(id_column, *names), id_column, "inner")


def search(
    df: DataFrame, vector: Sequence[float], limit: int = 5, *, id_column: str, vector_column: str = "embedding",
    threshold: float | None = None, payload: Sequence[str] = (), where: Column | None = None,
) -> DataFrame:
    """Cosine search with an optional filter before ranking; as many hits as asked for."""
    rows = df if where is None else df.where(where)
    hits = nearest(
        rows, vector, limit, id_column=id_column, vector_column=vector_column, threshold=threshold
    )
    return with_payload(hits, df, id_column, payload) if payload else hits


def nearest_many(
    df: DataFrame, queries: DataFrame, k: int = 10, *, id_column: str, query_id: str, vector_column: str = "embedding",
    query_vector: str = "embedding", metric: str = "cosine", wave_numbers: int = WAVE_NUMBERS,
) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` nearest rows of every query. A query without a vector has none.

    Vectors are never shuffled. The queries are written to files of bounded size in the shared folder; tasks read them there and
    keep the best rows of all their batches. As many files as a task can hold make a wave; further queries are further
    waves over the vectors. Only names of files pass through the driver.
    """
    spark = df.sparkSession
    id_kind, query_kind = df.schema[id_column].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    schema = f"query_id {query_kind}, id {id_kind}, score double"
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("vector"))
    folder = fresh_path(spark, "queries")
    bounds = vector_sizes(asked, "vector").collect()  # a sound set gives one row
    if len(bounds) > 1:
        raise ValueError(f"query vectors of sizes {sorted(b.vector_size for b in bounds)}")
    width = bounds[0].vector_size if bounds else 0
    per_wave = max(1, min(wave_numbers // max(1, width), WAVE_HITS // max(1, k)))
    asked.write.option("maxRecordsPerFile", max(1, per_wave // 4)).parquet(folder)
    sizes = spark.read.schema(asked.schema).parquet(folder).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).orderBy("file").collect()
    waves: list[list[str]] = []
    held = 0
    for row in sizes:
        if not waves or held + row.n > per_wave:
            waves, held = [*waves, []], 0
        waves[-1].append(row.file)
        held += row.n
    rows = df.select(id_column, vector_column)
    parts = [rows.mapInArrow(ranking_task(id_column, vector_column, partial(read_queries, files, width), k, metric), schema) for files in waves]
    if not parts:
        return spark.createDataFrame([], f"query_id {query_kind}, {id_column} {id_kind}, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("id").alias(id_column), "score", "rank")


def hybrid_search(
    vectors: DataFrame, raw: DataFrame, vector: Sequence[float], *, id_column: str, keys: Sequence[str], n: int = 100,
    vector_column: str = "embedding", where_vectors: Column | None = None, where_raw: Column | None = None,
    metric: str = "cosine",
) -> DataFrame:
    """Filter vectors, rank them, take the distinct keys of the best, return the raw rows of those keys.

    The filter of the raw side applies to every key.
    """
    pool = vectors if where_vectors is None else vectors.where(where_vectors)
    hits = nearest(pool, vector, n, id_column=id_column, vector_column=vector_column, metric=metric)
    if list(keys) != [id_column]:
        hits = hits.join(pool.select(id_column, *[k for k in keys if k != id_column]), id_column)
    wanted = hits.select(*keys).distinct()
    rows = raw if where_raw is None else raw.where(where_raw)
    # At most n keys; Spark broadcasts them if they are few.
    return rows.join(wanted, list(keys), "left_semi")


def first_nonempty_stage(
    stages: Mapping[str, Callable[[DataFrame | None], DataFrame]], asked: DataFrame | None = None, query_id: str | None = None
) -> DataFrame:
    """The rows of the first stage that returns any, with its name as ``source``; with ``asked`` per query.

    Stages are functions and are called one after the other: the next only if something is left to answer, and with the
    queries (``asked``'s rows) that none has answered so far. A stage's rows are written to the shared folder once.
    """
    answered: list[DataFrame] = []
    left = asked
    for name, search in stages.items():
        hits = stage(search(left).withColumn("source", F.lit(name)), "hits")
        answered.append(hits)
        if left is None:
            if not hits.isEmpty():
                return hits
        else:
            left = stage(left.join(hits.select(query_id).distinct(), query_id, "left_anti"), "unanswered")
            if left.isEmpty():
                break
    return answered[-1] if asked is None else reduce(DataFrame.unionByName, answered)


def tokens(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def embed_text(df: DataFrame, text_column: str, size: int = 64, name: str = "embedding") -> DataFrame:
    """Hashed token counts of length one: the default encoder, entirely in the JVM."""
    prepared = df.withColumn("__tokens", tokens(F.coalesce(F.col(text_column), F.lit(""))))
    counted = HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=size).transform(prepared)
    scaled = Normalizer(inputCol="__tf", outputCol="__unit", p=2.0).transform(counted)
    return scaled.withColumn(name, vector_to_array("__unit", "float32")).drop("__tokens", "__tf", "__unit")


def embed_with(
    df: DataFrame, text_column: str, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 640,
    name: str = "embedding",
) -> DataFrame:
    """Encode text with a model that ``load`` builds once per task; ``batch`` texts per call."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = part.fillna("").tolist()
            vectors = [model(texts[i:i + batch]) for i in range(0, len(texts), batch)]
            yield pd.Series(list(np.concatenate(vectors).astype(np.float32)) if vectors else [], dtype=object)

    return df.withColumn(name, encode(F.col(text_column)))


def text_search(
    df: DataFrame, text_column: str, query: str, limit: int = 100, *, id_column: str, stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Rows with any query term, ranked by summed term count times ``ln(1 + rows / rows with the term)``.

    The text is read once: rows that contain a term leave their counts, which are then weighted.
    Nothing is exploded or joined, so frequent terms cost no more than rare ones.
    """
    terms = sorted({w for w in _words(query) if w not in stop_words})
    if not terms:
        return df.limit(0).select(id_column, F.lit(0.0).alias("score"))
    letter = r"[\p{L}\p{N}_]"
    whole_words = rf"(?<!{letter})({'|'.join(terms)})(?!{letter})"
    text = F.col("__text")
    present = reduce(lambda a, b: a | b, [text.contains(t) for t in terms])

    def count_of(term: str) -> Column:
        return F.size(F.filter("__hits", lambda x: x == term))

    counts = stage(
        df.select(id_column, F.lower(text_column).alias("__text")).where(present)
        .select(id_column, F.regexp_extract_all("__text", F.lit(whole_words), 1).alias("__hits"))
        .select(id_column, *[count_of(t).alias(f"__f{i}") for i, t in enumerate(terms)]),
        "terms",
    )
    total = df.count()
    seen = counts.agg(*[F.count_if(F.col(f"__f{i}") > 0) for i in range(len(terms))]).first()
    weights = [math.log(1 + total / n) if n else 0.0 for n in seen]
    score = sum((F.col(f"__f{i}") * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))
    return (
        counts.select(id_column, F.round(score, 6).alias("score")).where("score > 0")
        .orderBy(F.desc("score"), id_column).limit(limit)
    )


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def search_tables(
    tables: Mapping[str, DataFrame], vector: Sequence[float], limit: int = 5, *, id_columns: Mapping[str, str],
    payload: Mapping[str, Sequence[str]], vector_column: str = "embedding",
) -> DataFrame:
    """The same search in several tables, the hits stacked with their table's name."""
    return tagged_union({
        name: search(df, vector, limit, id_column=id_columns[name], vector_column=vector_column, payload=payload.get(name, ()))
        for name, df in tables.items()
    })


def latest_points(points: DataFrame, id_column: str, version: Sequence[Column]) -> DataFrame:
    """One row per id, the newest version; copies of a hot id are cut in every task before the shuffle."""
    return newest_per_key(points, [id_column], version, 1)
