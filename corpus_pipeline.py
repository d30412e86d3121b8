"""From raw documents to token ids: toxic documents go, repeated lines go, of near duplicates one stays, documents with
benchmark items go, the rest is encoded.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it has kept. A document that loses all
its lines keeps an empty text; the near-duplicate stage then keeps one of the empty ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import bpe, decontaminate, line_dedup, near_copies, toxicity
from emberlake.llm.common import table
from emberlake.session import stage


#: How many rows go to Python at once, unless the session says otherwise: the default of 10,000 whole texts fills an executor's memory
#: beside its heap several times over, in each task and on both sides.
ROWS_AT_ONCE = 1_000
_ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _in_small_batches(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(step)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_ROWS_AT_ONCE, None) is None:
            spark.conf.set(_ROWS_AT_ONCE, str(ROWS_AT_ONCE))
        return step(spark, docs, sf_dir)

    return call


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.default_vocabulary()).drop("text")
    coded = coded.withColumn("n_tokens", F.size("ids").cast("long"))
    return bpe.decode(coded, bpe.default_vocabulary())


STAGES = [
    ("toxicity", _in_small_batches(drop_toxic)),
    ("line_dedup", _in_small_batches(drop_repeated_lines)),
    ("simhash", _in_small_batches(drop_near_duplicates)),
    ("decontamination", _in_small_batches(drop_contaminated)),
    ("bpe", _in_small_batches(encode)),
]

#: SQL cannot express the fitted lexicon and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
