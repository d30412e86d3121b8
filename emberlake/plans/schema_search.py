"""Schema-driven search: many questions against a document collection, without comparing all pairs.

Every criterion becomes a lookup in a posting index: an identifier value, a postcode prefix, or the words of the address that
contain the asked part. Questions with the same criteria share one search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.questions import analyse, relevance
from emberlake.plans.posting_index import PostingIndex, build_index, search_index
from emberlake.session import stage
from emberlake.spec import CollectionSpec

WORD = r"([\p{L}\p{N}_]+)"


def document_keys(documents: DataFrame, key: str, spec: CollectionSpec) -> DataFrame:
    """``kind, term, doc`` rows: what each document can be found by."""
    def entries_of(kind: str, terms: Column) -> Column:
        return F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    parts = [entries_of(f, F.col(f).cast("array<string>")) for f in spec.exact_match_fields if f in documents.columns]
    if "POSTCODE" in documents.columns:
        prefixes = F.flatten(F.transform("POSTCODE", lambda p: F.transform(
            F.when(F.length(p) >= 2, F.sequence(F.lit(2), F.length(p))).otherwise(F.array().cast("array<int>")),
            lambda n: F.substring(F.upper(p), F.lit(1), n),
        )))
        parts.append(entries_of("POSTCODE", prefixes))
    if "ADDRESS" in documents.columns:
        words = F.flatten(F.transform("ADDRESS", lambda a: F.regexp_extract_all(F.upper(a), F.lit(WORD), 1)))
        parts.append(entries_of("ADDRESS", words))
    entries = F.array_distinct(F.concat(*[F.coalesce(p, F.array().cast("array<struct<kind:string,term:string>>")) for p in parts]))
    return documents.select(F.col(key).alias("doc"), F.explode(entries).alias("e")).select("e.kind", "e.term", "doc")


def _grams(text: Column) -> Column:
    """All distinct pieces of one to three letters of a word."""
    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of_size(n) for n in (1, 2, 3)]))


def with_terms(analysed: DataFrame) -> DataFrame:
    """Add ``terms``, what a question looks for, and ``search``, its fingerprint.

    A search is a set of criteria that must all hold; questions with the same criteria share one.
    Postcodes are one criterion with several terms. Without any criterion the first number of the
    question is looked up as a property reference.
    """
    none = (F.size("exact") == 0) & (F.size("postcodes") == 0) & F.col("street").isNull()
    item = "struct<criterion:string,kind:string,term:string>"

    def term(criterion: Column, kind: Column, value: Column) -> Column:
        return F.struct(criterion.alias("criterion"), kind.alias("kind"), value.alias("term")).cast(item)

    terms = F.concat(
        F.transform("exact", lambda e: term(e["field"], e["field"], e["value"])),
        F.transform(F.array_distinct("postcodes"), lambda p: term(F.lit("POSTCODE"), F.lit("POSTCODE"), p)),
        F.array_compact(F.array(F.when(F.col("street").isNotNull(), term(F.lit("ADDRESS"), F.lit("ADDRESS"), F.col("street"))))),
        F.array_compact(F.array(F.when(none & F.col("number").isNotNull(), term(F.lit("UPRN"), F.lit("UPRN"), F.col("number"))))),
    )
    return analysed.withColumn("terms", F.array_sort(terms)).withColumn("search", F.sha2(F.to_json("terms"), 256))


def search_terms(asked: DataFrame) -> DataFrame:
    """``search, criteria, criterion, kind, term`` per search of questions ``with_terms``."""
    searches = asked.where(F.size("terms") > 0).groupBy("search").agg(F.any_value("terms").alias("terms"))
    criteria = F.size(F.array_distinct(F.transform("terms", lambda t: t["criterion"])))
    return searches.select("search", criteria.alias("criteria"), F.explode("terms").alias("t")).select("search", "criteria", "t.*")


def _with_address_words(terms: DataFrame, index: PostingIndex) -> DataFrame:
    """Replace each asked address part by the address words that contain it.

    An asked part is a piece of one word, so it is matched against the vocabulary of address words,
    by a shared piece of up to three letters, and never against the addresses.
    """
    asked = terms.where("kind = 'ADDRESS'").select("term").distinct().withColumn("piece", F.left(F.col("term"), F.lit(3)))
    words = index.terms.where("kind = 'ADDRESS'").select(F.col("term").alias("word"), F.explode(_grams(F.col("term"))).alias("piece"))
    pairs = asked.join(words, "piece").where(F.col("word").contains(F.col("term"))).select("term", "word").distinct()
    address = terms.where("kind = 'ADDRESS'").join(pairs, "term", "left").select("search", "criteria", "criterion", "kind", F.coalesce("word", "term").alias("term"))
    return terms.where("kind <> 'ADDRESS'").unionByName(address)


def collection_index(documents: DataFrame, spec: CollectionSpec, key: str = "_id", path: str | None = None) -> PostingIndex:
    """The posting index of a collection, stored below ``path`` or a new folder of the shared one."""
    # A Parquet row group is one task, and a document has dozens of terms: all cores share the documents.
    found_by = [c for c in dict.fromkeys([key, *spec.exact_match_fields, "POSTCODE", "ADDRESS"]) if c in documents.columns]
    shared = documents.select(*found_by).repartition(documents.sparkSession.sparkContext.defaultParallelism)
    return build_index(document_keys(shared, key, spec), documents.count(), path)


def find_documents(
    asked: DataFrame, documents: DataFrame, spec: CollectionSpec, question_id: str, key: str, limit: int = 20,
    index: PostingIndex | None = None,
) -> DataFrame:
    """``question_id, doc``: up to ``limit`` documents per question ``with_terms``, by document key.

    ``index`` is a stored index of ``documents``; without one it is built for this call.
    """
    index = index or collection_index(documents, spec, key)
    asked = asked.select(F.col(question_id).alias("question_id"), "terms", "search")
    found = search_index(index, stage(_with_address_words(search_terms(asked), index), "lookups"), limit)
    answered = asked.where(F.size("terms") > 0).join(found, "search").select("question_id", "doc")

    # No criterion and no number: the first ``limit`` documents of the collection.
    first = [row["doc"] for row in documents.select(F.col(key).alias("doc")).orderBy("doc").limit(limit).collect()]
    kind = documents.schema[key].dataType
    general = asked.where(F.size("terms") == 0).select("question_id", F.explode(F.array(*[F.lit(d).cast(kind) for d in first]).cast(f"array<{kind.simpleString()}>")).alias("doc"))
    return answered.unionByName(general)


def schema_search(
    questions: DataFrame, documents: DataFrame, spec: CollectionSpec, *, question: str = "question", question_id: str = "question_id",
    key: str = "_id", limit: int = 20, index: PostingIndex | None = None,
) -> DataFrame:
    """Documents found for each question, with intent, confidence and relevance."""
    # Questions are few beside the documents and dear to analyse: all cores share them.
    shared = questions.repartition(questions.sparkSession.sparkContext.defaultParallelism)
    analysed = stage(with_terms(analyse(shared, spec, question)), "analysed")
    pairs = find_documents(analysed, documents, spec, question_id, key, limit, index)
    fields = [c for c in spec.essential_columns if c in documents.columns and c not in spec.exclude_columns]
    kinds = {f.name: f.dataType.typeName() for f in documents.schema}
    view = {
        c: (F.to_json(F.col(c)) if kinds[c] in ("struct", "map") else F.col(c), kinds[c] == "array") for c in fields
    }
    joined = pairs.join(documents.select(F.col(key).alias("doc"), *fields), "doc").join(
        analysed.withColumnRenamed(question_id, "question_id"), "question_id"
    )
    return joined.select(
        "question_id", "doc", *fields, F.struct("intent", "confidence", "entities").alias("context"), F.round(relevance(view), 6).alias("relevance"),
        "search_fields",
    )
