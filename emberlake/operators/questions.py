"""What a question asks for: keywords, identifiers, places, intent. All expressions over a question column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake import spec as S
from emberlake.functions.parsing import strip
from emberlake.spec import CollectionSpec

WORD = r"([\p{L}\p{N}_]+)"


def keywords(question: Column, stop_words: Sequence[str] = S.STOP_WORDS) -> Column:
    """Lower-case words of more than two letters that are no stop words; order and repeats kept."""
    words = F.regexp_extract_all(F.lower(question), F.lit(WORD), 1)
    return F.filter(words, lambda w: ~w.isin(*stop_words) & (F.length(w) > 2))


def mentions_any(question: Column, words: Sequence[str]) -> Column:
    """True when any of the words occurs anywhere in the question, in either case."""
    lowered = F.lower(question)
    found = F.lit(False)
    for w in words:
        found = found | lowered.contains(w.lower())
    return found


def mentioned(question: Column, words: Sequence[str]) -> Column:
    """The words that occur in the question, in the order of the list."""
    lowered = F.lower(question)
    return F.array_compact(F.array(*[F.when(lowered.contains(w.lower()), F.lit(w)) for w in words]))


def wants_chart(question: Column) -> Column:
    return mentions_any(question, S.CHART_WORDS)


def routed_tables(question: Column, available: Sequence[str], selected: Sequence[str] = (), known: Mapping[str, Sequence[str]] = S.TABLE_KEYWORDS, most: int | None = None) -> Column:
    """Tables a question is about; all when none is recognised. ``most`` keeps the first so many when nothing is selected."""
    hits = F.array_compact(F.array(*[
        F.when(mentions_any(question, words), F.lit(name)) for name, words in known.items() if name in available
    ]))
    relevant = F.when(F.size(hits) > 0, hits).otherwise(F.array(*[F.lit(t) for t in available]))
    if not selected:
        return relevant if most is None else F.slice(relevant, 1, most)
    return F.array_sort(F.array_union(F.array(*[F.lit(t) for t in selected]), relevant))


def _found(text: Column, pattern: str) -> Column:
    value = F.regexp_extract(text, pattern, 1)
    return F.when(value != "", value)


def identifier(question: Column, field: str) -> Column:
    """The value after an identifier's name, upper-cased. UPRN also accepts text in between."""
    lowered, name = F.lower(question), field.lower()
    value = _found(lowered, rf"{name}\s+([A-Za-z0-9]+)")
    if name == "uprn":
        value = F.coalesce(value, _found(lowered, r"uprn.*?(\d+)"))
    return F.upper(value)


def postcodes(question: Column) -> Column:
    return F.regexp_extract_all(F.upper(F.lower(question)), F.lit(S.POSTCODE_PATTERN), 1)


def street(question: Column) -> Column:
    """The word before drive, road, street, avenue, lane or close; the first kind that matches wins."""
    lowered = F.lower(question)
    return F.upper(F.coalesce(*[_found(lowered, rf"{WORD}\s+{w}") for w in S.STREET_WORDS]))


def api_service(question: Column) -> Column:
    lowered = F.lower(question)
    first = F.coalesce(*[F.when(lowered.contains(s), F.lit(s)) for s in S.API_SERVICES])
    return F.when(lowered.contains("api") & lowered.contains("status"), first)


def analyse(df: DataFrame, spec: CollectionSpec, question: str = "question") -> DataFrame:
    """Add what schema search needs: ``exact``, ``postcodes``, ``street``, ``intent``, ``confidence``,
    ``entities``, ``search_fields`` and the fall-back ``number``.

    Later rules win: an API-status question beats an address, an address beats a postcode, a postcode
    beats an identifier.
    """
    q = F.col(question)
    ids = {f: identifier(q, f) for f in spec.exact_match_fields}
    base = df.withColumns({f"__id_{f}": c for f, c in ids.items()} | {
        "postcodes": postcodes(q), "street": street(q), "__service": api_service(q),
    })
    id_column = {f: F.col(f"__id_{f}") for f in ids}
    exact = F.array_compact(F.array(*[
        F.when(c.isNotNull(), F.struct(F.lit(f).alias("field"), c.alias("value"))) for f, c in id_column.items()
    ])) if ids else F.array().cast("array<struct<field:string,value:string>>")
    # The last identifier found names the intent.
    by_id = F.coalesce(*[F.when(c.isNotNull(), F.lit(f"find_by_{f.lower()}")) for f, c in reversed(id_column.items())], F.lit(None).cast("string"))
    has_place = F.size("postcodes") > 0
    intent = F.coalesce(
        F.when(F.col("__service").isNotNull(), F.lit("api_status_check")),
        F.when(F.col("street").isNotNull(), F.lit("address_search")),
        F.when(has_place, F.lit("location_search")),
        by_id,
        F.lit("general_search"),
    )
    confidence = (
        F.when(F.col("__service").isNotNull(), 0.9)
        .when(has_place & mentions_any(q, S.LOCATION_WORDS), 0.9)
        .when(F.col("street").isNotNull(), 0.8)
        .when(has_place, 0.85)
        .when(by_id.isNotNull(), 0.9)
        .otherwise(0.0)
    )
    entities = F.concat(
        F.array_compact(F.array(F.concat(F.col("__service"), F.lit("_api")))), mentioned(q, spec.key_entities)
    )
    number = _found(q, r"(\d+)")
    out = base.withColumns({
        "exact": exact, "intent": intent, "confidence": confidence, "entities": entities, "number": number,
    })
    return out.withColumn("search_fields", search_fields(F.col("intent"), spec)).drop("__service", *[f"__id_{f}" for f in ids])


def search_fields(intent: Column, spec: CollectionSpec) -> Column:
    result = F.when(intent == "general_search", F.array(*[F.lit(c) for c in spec.essential_columns]))
    for name, fields in S.INTENT_FIELDS.items():
        result = result.when(intent == name, F.array(*[F.lit(c) for c in fields]))
    return result.otherwise(F.array().cast("array<string>"))


def query_features(question: Column) -> Column:
    lowered = F.lower(question)
    words = F.filter(F.split(question, r"\s+"), lambda w: w != "")
    return F.struct(
        F.size(words).alias("word_count"),
        question.rlike(r"\p{Nd}").alias("has_numbers"),
        mentions_any(question, S.DATE_WORDS).alias("has_dates"),
        mentioned(lowered, S.BUSINESS_TERMS).alias("business_keywords"),
        mentioned(lowered, S.TECHNICAL_TERMS).alias("technical_keywords"),
    )


def too_short(question: Column, least: int = 8) -> Column:
    return F.length(strip(question)) < least


def mentions_column(question: Column, columns: Sequence[str]) -> Column:
    return mentions_any(question, columns)


def relevance(document: Mapping[str, tuple[Column, bool]]) -> Column:
    """Score of a document for an analysed question, as an expression over their joined row.

    ``document`` maps each field to its column and whether it is an array. 0.4 x confidence, 0.3 per
    exact match, 0.2 per matched part, 0.1 per entity that occurs in any value; at most 1.
    """
    def exact_hit(item: Column) -> Column:
        hit = F.lit(False)
        for name, (column, is_array) in document.items():
            same = F.array_contains(column, item["value"]) if is_array else column.cast("string") == item["value"]
            hit = hit | ((item["field"] == name) & F.coalesce(same, F.lit(False)))
        return hit

    def part_hits(name: str, values: Column) -> Column:
        if name not in document:
            return F.lit(0)
        column, is_array = document[name]
        if is_array:
            return F.size(F.filter(values, lambda v: F.coalesce(
                F.exists(column, lambda x: F.lower(x).contains(F.lower(v))), F.lit(False))))
        any_hit = F.exists(values, lambda v: F.lower(column.cast("string")).contains(F.lower(v)))
        return F.coalesce(any_hit, F.lit(False)).cast("int")

    texts = [
        F.lower(F.array_join(column.cast("array<string>"), "\n") if is_array else column.cast("string"))
        for column, is_array in document.values()
    ]
    everything = F.concat_ws("\n", *texts)
    score = (
        F.col("confidence") * 0.4
        + F.size(F.filter("exact", exact_hit)) * 0.3
        + part_hits("POSTCODE", F.col("postcodes")) * 0.2
        + part_hits("ADDRESS", F.array_compact(F.array("street"))) * 0.2
        + F.size(F.filter("entities", lambda e: everything.contains(F.lower(e)))) * 0.1
    )
    return F.least(score, F.lit(1.0))
