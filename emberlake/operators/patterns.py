"""Question patterns: scoring, best match, query enhancement, fuzzy names.

A collection's own patterns, a bounded list, sit beside the question as an array, and an expression reduces it to the best one.
Stored patterns, any number of them, are found by an index of their texts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.containment import contained_pairs
from emberlake.operators.questions import mentioned, mentions_any
from emberlake.session import stage
from emberlake.spec import MATCH_THRESHOLD, CollectionSpec, Pattern

# Scores of the match rules.
SCORE_PATTERN, SCORE_SAMPLE, SCORE_CAP = 0.95, 0.9, 0.85
WEIGHT_ENTITIES, WEIGHT_KEYWORDS = 0.4, 0.6

PATTERN_TYPE = (
    "struct<place:double, question_pattern:string, answer_intent:string, samples:array<string>, "
    "entities:array<string>, expected_columns:array<string>, search_strategy:string>"
)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def pattern_array(patterns: Sequence[Pattern]) -> Column:
    """Patterns as a constant array column; ``place`` is the position, the smaller wins a tie."""
    items = [
        F.struct(
            F.lit(float(i)).alias("place"), F.lit(p.question_pattern).alias("question_pattern"),
            F.lit(p.answer_intent).alias("answer_intent"), _strings(p.sample_queries).alias("samples"),
            _strings(p.business_entities).alias("entities"), _strings(p.expected_columns).alias("expected_columns"),
            F.lit(p.search_strategy).alias("search_strategy"),
        ).cast(PATTERN_TYPE)
        for i, p in enumerate(patterns)
    ]
    return F.array(*items).cast(f"array<{PATTERN_TYPE}>")


def keyword_share(question: Column, spec: CollectionSpec) -> Column:
    """Share of all intent keywords of the collection, repeats included, that occur in the question."""
    words = spec.all_intent_keywords
    if not words:
        return F.lit(0.0)
    lowered = F.lower(question)
    hits = sum((lowered.contains(w.lower()).cast("int") for w in words), F.lit(0))
    return hits / F.lit(float(len(words)))


def pattern_score(pattern: Column, lowered: Column, keywords: Column) -> Column:
    """Score of one pattern, for a lower-case question and its keyword share."""
    def meets(text: Column) -> Column:
        return lowered.contains(F.lower(text)) | F.lower(text).contains(lowered)

    total = F.size(pattern["entities"])
    entity_share = F.when(total > 0, F.size(F.filter(pattern["entities"], lambda e: lowered.contains(F.lower(e)))) / total).otherwise(0.0)
    return (
        F.when(meets(pattern["question_pattern"]), SCORE_PATTERN)
        .when(F.exists(pattern["samples"], meets), SCORE_SAMPLE)
        .otherwise(F.least(entity_share * WEIGHT_ENTITIES + keywords * WEIGHT_KEYWORDS, F.lit(SCORE_CAP)))
    )


def _best(patterns: Column, lowered: Column, keywords: Column, threshold: float) -> Column:
    """The best pattern as a struct that sorts first: highest score, then smallest place."""
    scored = F.transform(patterns, lambda p: F.struct(
        (-pattern_score(p, lowered, keywords)).alias("negative"), p["place"].alias("place"),
        p["question_pattern"].alias("question_pattern"), p["answer_intent"].alias("answer_intent"),
        p["expected_columns"].alias("expected_columns"), p["search_strategy"].alias("search_strategy"),
    ))
    return F.array_min(F.filter(scored, lambda s: s["negative"] <= -threshold))


def match_patterns(
    df: DataFrame, spec: CollectionSpec, question: str = "question", stored: DataFrame | None = None,
    threshold: float = MATCH_THRESHOLD,
) -> DataFrame:
    """Add ``match``: the best pattern at or above the threshold, null without one.

    ``stored`` holds further patterns (``question_pattern, answer_intent, samples, entities,
    expected_columns, search_strategy, confidence_score``), taken after the collection's own in order
    of confidence, pattern and intent, and found by pieces of their texts; those without a pattern are left out, and so are empty entities.
    """
    q = F.col(question)
    prepared = df.withColumns({"__q": F.lower(q), "__k": keyword_share(q, spec)})
    own = pattern_array(spec.patterns)
    best = _best(own, F.col("__q"), F.col("__k"), threshold)
    if stored is not None:
        prepared = _stored_best(prepared, _stored_rows(stored), threshold)
        late = F.col("__late")
        best = F.when(best.isNull() | (late["negative"] < best["negative"]), late).otherwise(best) if spec.patterns else late
    return prepared.withColumn("__m", best).withColumn("match", F.when(F.col("__m").isNotNull(), F.struct(
        F.col("__m.question_pattern").alias("question_pattern"), F.col("__m.answer_intent").alias("answer_intent"),
        (-F.col("__m.negative")).alias("score"), F.col("__m.expected_columns").alias("expected_columns"),
        F.col("__m.search_strategy").alias("search_strategy"),
    ))).select(*df.columns, "match")


def _stored_rows(stored: DataFrame) -> DataFrame:
    def array_or_empty(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name)

    return stored.where("question_pattern is not null").select(
        "question_pattern", "answer_intent", array_or_empty("samples"),
        F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: e != "").alias("entities"),
        array_or_empty("expected_columns"), F.coalesce("search_strategy", F.lit("")).alias("search_strategy"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
    ).distinct()


def _candidate(score: Column, best: Column) -> Column:
    """A pattern with its score, as a struct that sorts first where it is better."""
    return F.struct((-score).alias("negative"), *[best[n].alias(n) for n in ("place", "question_pattern", "answer_intent", "expected_columns", "search_strategy")])


def _stored_best(df: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Add ``__late``, the best stored pattern of each question at or above the threshold.

    Patterns whose text or samples contain the question, or are contained in it, are found by pieces of their texts. Equal
    texts stand for the best of their patterns. Patterns that score by their entities can only reach the threshold for questions
    whose keyword share leaves enough; only those meet entities, and equal lists of entities are one.
    """
    asked = stage(df.select("__q", "__k").where("__q is not null").distinct(), "asked")
    best = F.min(F.struct((-F.col("confidence_score")).alias("place"), "question_pattern", "answer_intent", "expected_columns", "search_strategy")).alias("best")
    by_text = [
        rows.select(F.lower("question_pattern").alias("text"), F.lit(SCORE_PATTERN).alias("score"), *rows.columns),
        rows.select(F.explode(F.transform("samples", F.lower)).alias("text"), F.lit(SCORE_SAMPLE).alias("score"), *rows.columns),
    ]
    texts = stage(by_text[0].unionByName(by_text[1]).where(F.col("text").isNotNull() & (F.col("score") >= threshold)).groupBy("text", "score").agg(best), "texts")
    inside = contained_pairs(texts.select(F.col("text").alias("part")), asked.select(F.col("__q").alias("whole"))).select(F.col("part").alias("text"), F.col("whole").alias("__q"))
    around = contained_pairs(asked.select(F.col("__q").alias("part")), texts.select(F.col("text").alias("whole"))).select(F.col("whole").alias("text"), F.col("part").alias("__q"))
    by_text_found = inside.unionByName(around).join(texts, "text").select("__q", _candidate(F.col("score"), F.col("best")).alias("c"))

    # The keyword share bounds what entities can add.
    score = lambda share: F.least(share * WEIGHT_ENTITIES + F.col("__k") * WEIGHT_KEYWORDS, F.lit(SCORE_CAP))
    lists = rows.withColumn("list", F.transform("entities", F.lower)).groupBy("list").agg(best)
    words = lists.select("list", F.explode("list").alias("entity")).groupBy("list", "entity").agg(F.count("*").alias("times"))
    able = asked.where(score(F.lit(1.0)) >= threshold)
    met = contained_pairs(words.select(F.col("entity").alias("part")), able.select(F.col("__q").alias("whole"))).select(F.col("part").alias("entity"), F.col("whole").alias("__q"))
    hits = met.join(words, "entity").groupBy("__q", "list").agg(F.sum("times").alias("hits"))
    scored = hits.join(lists, "list").join(able, "__q").withColumn("s", score(F.col("hits") / F.size("list"))).where(F.col("s") >= threshold)
    found = by_text_found.unionByName(scored.select("__q", _candidate(F.col("s"), F.col("best")).alias("c")))

    # What holds for all questions alike: an empty text is in each of them, an empty question is in each text, and
    # without any entity the first pattern is as good as all others.
    everywhere = texts.where("text = ''").agg(F.min(_candidate(F.col("score"), F.col("best"))).alias("c")).scalar()
    anywhere = texts.agg(F.min(_candidate(F.col("score"), F.col("best"))).alias("c")).scalar()
    first = lists.agg(F.min("best").alias("best")).scalar()
    found = asked.join(found.groupBy("__q").agg(F.min("c").alias("c")), "__q", "left")
    more = [F.col("c"), everywhere, F.when(F.col("__q") == "", anywhere)]
    if threshold <= WEIGHT_KEYWORDS:
        more.append(F.when(score(F.lit(0.0)) >= threshold, _candidate(score(F.lit(0.0)), first)))
    late = found.select("__q", F.array_min(F.array_compact(F.array(*more))).alias("__late"))
    return df.join(late, "__q", "left")


def intents_mentioned(question: Column, words: Mapping[str, Sequence[str]]) -> Column:
    return F.array_compact(F.array(*[F.when(mentions_any(question, w), F.lit(name)) for name, w in words.items()]).cast("array<string>"))


def expansions(question: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """All synonyms of the business terms a question mentions."""
    lists = [F.when(mentions_any(question, [term]), _strings(words)).otherwise(_strings([])) for term, words in aliases.items()]
    return F.concat(*lists) if lists else _strings([])


def expanded(question: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """The question with each synonym appended that its text so far does not contain."""
    result = question
    return F.aggregate(
        expansions(question, aliases), result,
        lambda acc, word: F.when(F.lower(acc).contains(F.lower(word)), acc).otherwise(F.concat(acc, F.lit(" "), word)),
    )


def relevant_columns(question: Column, spec: CollectionSpec) -> Column:
    """Documented columns one of whose keywords the question mentions, with their relevance."""
    known = [e for e in spec.dictionary if e.include_in_context and e.keywords]
    items = [
        F.when(mentions_any(question, e.keywords), F.struct(F.lit(e.column).alias("name"), F.lit(e.relevance).alias("relevance")))
        for e in known
    ]
    kind = "array<struct<name:string,relevance:string>>"
    return F.array_compact(F.array(*items)) if items else F.array().cast(kind)


def enhance(df: DataFrame, spec: CollectionSpec, question: str = "question", stored: DataFrame | None = None) -> DataFrame:
    """Everything known about a question: match, intents, expansions, columns, strategy."""
    q = F.col(question)
    matched = match_patterns(df, spec, question, stored)
    own = F.array_compact(F.array(F.col("match.answer_intent")))
    intents = F.array_distinct(F.concat(own, intents_mentioned(q, spec.intent_keywords), intents_mentioned(q, spec.question_words)))
    expected = F.transform(
        F.coalesce(F.col("match.expected_columns"), _strings([])), lambda c: F.struct(c.alias("name"), F.lit("high").alias("relevance"))
    )
    more = F.filter(relevant_columns(q, spec), lambda c: ~F.exists(expected, lambda e: e["name"] == c["name"]))
    return matched.withColumns({
        "enhanced_query": expanded(q, spec.aliases),
        "business_domain": F.lit(spec.domain),
        "purpose": F.lit(spec.purpose),
        "detected_intent": intents,
        "semantic_expansions": expansions(q, spec.aliases),
        "relevant_columns": F.concat(expected, more),
        "search_strategy": F.when(F.size(intents) > 0, F.lit("semantic_search")).otherwise(F.lit("vector_search")),
        "confidence_score": F.coalesce(F.col("match.score"), F.lit(0.0)),
    })


# --- fuzzy names -----------------------------------------------------------------------------------

# Shared-character shares above which names count as similar.
CLOSE_SHARE, LOOSE_SHARE = 0.7, 0.5


def shared_share(a: Column, b: Column) -> Column:
    """Characters of ``a`` that occur in ``b``, over the longer length; 1 for equal names."""
    letters = F.filter(F.split(a, ""), lambda x: x != "")
    common = F.size(F.filter(letters, lambda x: b.contains(x)))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(longer > 0, common / longer).otherwise(0.0)


def name_score(a: Column, b: Column) -> Column:
    """2 for containment, 1 + share above the close share, else the share of the lower-case names."""
    la, lb = F.lower(a), F.lower(b)
    close = shared_share(a, b)
    return F.when(lb.contains(la) | la.contains(lb), 2.0).when(close > CLOSE_SHARE, close + 1).otherwise(shared_share(la, lb))


def match_names(asked: DataFrame, known: DataFrame, name: str = "name", per_chunk: int = 500) -> DataFrame:
    """``name, suggestion, score``: the known name most like each asked one, null below the loose share.

    Known names are packed into hash chunks of bounded size; a name leaves one candidate per chunk.
    """
    wanted, names = asked.select(name).dropna().distinct(), known.select(F.col(name).alias("__n")).dropna().distinct()
    chunks = max(1, math.ceil(names.count() / per_chunk))
    packed = names.groupBy(F.pmod(F.xxhash64("__n"), F.lit(chunks)).cast("int").alias("__c")).agg(F.collect_list("__n").alias("__names"))
    visits = wanted.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    candidates = F.transform("__names", lambda n: F.struct((-F.round(name_score(F.col(name), n), 9)).alias("s"), n.alias("n")))
    best = visits.join(packed, "__c").select(name, F.array_min(candidates).alias("b")).groupBy(name).agg(F.min("b").alias("b"))
    good = F.col("b.s") < -LOOSE_SHARE
    return wanted.join(best, name, "left").select(
        name, F.when(good, F.col("b.n")).alias("suggestion"), F.when(good, -F.col("b.s")).alias("score")
    )
