"""A stored index from terms to the documents that carry them, and searches for several terms at once.

Documents are dealt into blocks by a hash of their key. A posting is a row per kind of term, term and block with the sorted
keys of the block's documents, so the longest row is bounded by the size of a block, and a term that a third of all documents
carry is many rows on many tasks. Beside the postings stands the number of documents per term. On disk both are
partitioned by kind and by a hash of the term; a search joins on the partition columns as well, and reads only the folders of
the terms asked for.

A search is a set of criteria that must all hold; a criterion is met by any of its terms. With one criterion only the first
documents of each term are looked at. With several the criterion with the fewest documents gives candidates block by block, and the
others are tested in those blocks only, on arrays.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.operators.combine import newest_per_key
from emberlake.session import fresh_path

DOCS_PER_BLOCK = 4096
DOCS_PER_PART = 500_000


@dataclass(frozen=True)
class PostingIndex:
    """``terms``: kind, part, term, n. ``postings``: kind, part, term, block, docs. ``parts``: how many hash parts a kind has."""

    terms: DataFrame
    postings: DataFrame
    parts: int

    def part_of(self, term: Column) -> Column:
        return _part(term, self.parts)


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def build_index(keys: DataFrame, documents: int, path: str | None = None, docs_per_block: int = DOCS_PER_BLOCK) -> PostingIndex:
    """Index ``keys (kind, term, doc)`` of about so many ``documents``, and store it below ``path``, a new folder of the
    shared one if none is given.

    A key that occurs several times counts once; keys without a term or a document are left out.
    """
    spark = keys.sparkSession
    path = path or fresh_path(spark, "postings")
    parts, blocks = max(1, -(-documents // DOCS_PER_PART)), max(1, -(-documents // docs_per_block))
    key_type = keys.schema["doc"].dataType.simpleString()
    known = keys.where(F.col("term").isNotNull() & F.col("doc").isNotNull())
    # collect_set and its sort see at most the documents of one block.
    postings = known.groupBy("kind", "term", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int").alias("block")).agg(F.sort_array(F.collect_set("doc")).alias("docs"))
    _store(postings.withColumn("part", _part(F.col("term"), parts)), path, "postings")
    stored = _read(spark, path, "postings", f"term string, block int, docs array<{key_type}>")
    _store(stored.groupBy("kind", "part", "term").agg(F.sum(F.size("docs")).alias("n")), path, "terms")
    spark.range(1).select(F.lit(parts).alias("parts"), F.lit(key_type).alias("key_type")).coalesce(1).write.parquet(os.path.join(path, "about"))
    return PostingIndex(_read(spark, path, "terms", "term string, n bigint"), stored, parts)


def load_index(spark: SparkSession, path: str) -> PostingIndex:
    """An index that ``build_index`` has stored below ``path``."""
    about = spark.read.schema("parts int, key_type string").parquet(os.path.join(path, "about")).first()
    postings = _read(spark, path, "postings", f"term string, block int, docs array<{about['key_type']}>")
    return PostingIndex(_read(spark, path, "terms", "term string, n bigint"), postings, about["parts"])


def _read(spark: SparkSession, path: str, name: str, columns: str) -> DataFrame:
    return spark.read.schema(f"{columns}, kind string, part int").parquet(os.path.join(path, name))


def _store(rows: DataFrame, path: str, name: str) -> None:
    """One folder per kind and part; rebalancing splits what is large and joins what is small."""
    rows.hint("rebalance", "kind", "part").sortWithinPartitions("kind", "part", "term").write.partitionBy("kind", "part").parquet(os.path.join(path, name))


def search_index(index: PostingIndex, lookups: DataFrame, limit: int) -> DataFrame:
    """``search, doc``: up to ``limit`` documents per search, by document key.

    ``lookups`` holds ``search, criteria, criterion, kind, term``: ``criteria`` is the number of criteria of the search.
    """
    lookups = lookups.withColumn("part", index.part_of(F.col("term")))
    by_term = ["kind", "part", "term"]

    single = lookups.where("criteria = 1")
    asked = single.select(*by_term).distinct()
    first = index.postings.join(asked, by_term, "left_semi").select(*by_term, F.explode(F.slice("docs", 1, limit)).alias("doc"))
    first = newest_per_key(first, by_term, [F.col("doc")], limit)
    simple = single.join(first, by_term).select("search", "doc").distinct()

    several = lookups.where("criteria > 1")
    sizes = several.join(index.terms, by_term, "left").groupBy("search", "criterion").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    leading = sizes.groupBy("search").agg(F.min(F.struct("n", "criterion")).alias("least")).where("least.n > 0").select("search", F.col("least.criterion").alias("leading"))
    marked = several.join(leading, "search")
    candidates = marked.where("criterion = leading").join(index.postings, by_term).groupBy("search", "block").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))
    # Blocks cut the leading key of a search into rows of their own; a posting meets only the candidates of its block.
    tests = marked.where("criterion <> leading").select("search", "criteria", "criterion", *by_term).join(candidates, "search")
    tested = tests.join(index.postings.withColumnRenamed("docs", "having"), [*by_term, "block"])
    hits = tested.select("search", "block", "criteria", "criterion", F.explode(F.array_intersect("docs", "having")).alias("doc")).distinct()
    met = hits.groupBy("search", "doc").agg(F.count("*").alias("met"), F.any_value("criteria").alias("criteria")).where("met = criteria - 1").select("search", "doc")
    return newest_per_key(simple.unionByName(met), ["search"], [F.col("doc")], limit)
