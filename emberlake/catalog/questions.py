"""TXT queries and pattern matching JON-08."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlake import spec as S
from emberlake.catalog.base import query, rounded
from emberlake.operators import code_audit as A
from emberlake.operators import patterns as PT
from emberlake.operators import questions as Q
from emberlake.plans.schema_search import schema_search
from emberlake.plans.stand_ins import CONNECTIONS_SQL, QUESTIONS_SQL, connections, questions
from emberlake.sources.readers import table
from emberlake.spec import CONNECTIONS, TECH_DETAILS

QS = f"{QUESTIONS_SQL} q"
# All questions: the derived ones and every user turn of the conversations.
ALL_SQL = f"""(SELECT 'c' || CAST(question_id AS STRING) AS question_id, question FROM {QS}
  UNION ALL SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), text FROM conversations WHERE role = 'user')"""


def _all_questions(spark, sf):
    own = questions(spark, sf).select(F.concat(F.lit("c"), F.col("question_id").cast("string")).alias("question_id"), "question")
    turns = table(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    return own.unionByName(turns)


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(words, column: str = "lower(question)") -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.lower()}')" for w in words) + ")"


def _present(words) -> str:
    return f"list_filter({_list(words)}, lambda w: contains(lower(question), lower(w)))"


@query("txt01_keywords", f"""
SELECT question_id, array_to_string(list_filter(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+'), lambda w: len(w) > 2 AND NOT list_contains({_list(S.STOP_WORDS)}, w)), ';') AS keywords FROM {ALL_SQL} q""")
def _(spark, sf):
    return rounded(_all_questions(spark, sf).select("question_id", Q.keywords(F.col("question")).alias("keywords")))


@query("txt02_chart_request", f"SELECT question_id, {_any(S.CHART_WORDS)} AS wants_chart FROM {ALL_SQL} q")
def _(spark, sf):
    return _all_questions(spark, sf).select("question_id", Q.wants_chart(F.col("question")).alias("wants_chart"))


_ROUTES = "list_filter([" + ", ".join(f"CASE WHEN {_any(w)} THEN '{t}' END" for t, w in S.TABLE_KEYWORDS.items()) + "], lambda t: t IS NOT NULL)"


@query("txt03_routing", f"""
WITH r AS (SELECT question_id, {_ROUTES} AS hits FROM {ALL_SQL} q), a AS (SELECT question_id, CASE WHEN len(hits) > 0 THEN hits ELSE {_list(S.TABLE_KEYWORDS)} END AS t FROM r)
SELECT question_id, array_to_string(t[1:2], ';') AS routed,
  array_to_string(list_sort(CASE WHEN list_contains(t, 'epcDomesticScotlands') THEN t ELSE list_append(t, 'epcDomesticScotlands') END), ';') AS with_selection FROM a""")
def _(spark, sf):
    names = list(S.TABLE_KEYWORDS)
    q = F.col("question")
    return rounded(_all_questions(spark, sf).select(
        "question_id", Q.routed_tables(q, names, most=2).alias("routed"), Q.routed_tables(q, names, ["epcDomesticScotlands"]).alias("with_selection")
    ))


def _identifier(field: str) -> str:
    first = f"nullif(regexp_extract(lower(question), '{field.lower()}\\s+([A-Za-z0-9]+)', 1), '')"
    if field == "UPRN":
        first = f"coalesce({first}, nullif(regexp_extract(lower(question), 'uprn.*?(\\d+)', 1), ''))"
    return f"upper({first})"


_POSTCODES = "regexp_extract_all(upper(question), '\\b([A-Z]{1,2}\\d{1,2}(?:\\s*\\d[A-Z]{2})?)\\b', 1)"
_STREET = "upper(coalesce(" + ", ".join(
    f"nullif(regexp_extract(lower(question), '([\\p{{L}}\\p{{N}}_]+)\\s+{w}', 1), '')" for w in S.STREET_WORDS) + "))"
_SERVICE = "CASE WHEN contains(lower(question), 'api') AND contains(lower(question), 'status') THEN CASE " + " ".join(
    f"WHEN contains(lower(question), '{s}') THEN '{s}'" for s in S.API_SERVICES) + " END END"
ANALYSED_SQL = f"""(SELECT *, CASE WHEN service IS NOT NULL THEN 'api_status_check' WHEN street IS NOT NULL THEN 'address_search' WHEN len(postcodes) > 0 THEN 'location_search'
    WHEN uprn IS NOT NULL THEN 'find_by_uprn' WHEN mprn IS NOT NULL THEN 'find_by_mprn' WHEN mpan IS NOT NULL THEN 'find_by_mpan' WHEN emsn IS NOT NULL THEN 'find_by_emsn' ELSE 'general_search' END AS intent,
  CASE WHEN service IS NOT NULL THEN 0.9 WHEN len(postcodes) > 0 AND {_any(S.LOCATION_WORDS)} THEN 0.9 WHEN street IS NOT NULL THEN 0.8 WHEN len(postcodes) > 0 THEN 0.85
    WHEN coalesce(uprn, mprn, mpan, emsn) IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence,
  list_concat(CASE WHEN service IS NOT NULL THEN [service || '_api'] ELSE [] END, {_present(CONNECTIONS.key_entities)}) AS entities
  FROM (SELECT question_id, question, {_identifier('EMSN')} AS emsn, {_identifier('MPAN')} AS mpan, {_identifier('MPRN')} AS mprn, {_identifier('UPRN')} AS uprn,
    {_POSTCODES} AS postcodes, {_STREET} AS street, {_SERVICE} AS service, nullif(regexp_extract(question, '(\\d+)', 1), '') AS number FROM {ALL_SQL} q))"""


@query("txt04_identifiers", f"SELECT question_id, emsn, mpan, mprn, uprn FROM {ANALYSED_SQL} a")
def _(spark, sf):
    q = F.col("question")
    return _all_questions(spark, sf).select("question_id", *[Q.identifier(q, f).alias(f.lower()) for f in ("EMSN", "MPAN", "MPRN", "UPRN")])


@query("txt05_postcodes", f"SELECT question_id, array_to_string(postcodes, ';') AS postcodes FROM {ANALYSED_SQL} a")
def _(spark, sf):
    return rounded(_all_questions(spark, sf).select("question_id", Q.postcodes(F.col("question")).alias("postcodes")))


@query("txt06_streets", f"SELECT question_id, street FROM {ANALYSED_SQL} a")
def _(spark, sf):
    return _all_questions(spark, sf).select("question_id", Q.street(F.col("question")).alias("street"))


@query("txt07_api_services", f"SELECT question_id, service FROM {ANALYSED_SQL} a")
def _(spark, sf):
    return _all_questions(spark, sf).select("question_id", Q.api_service(F.col("question")).alias("service"))


@query("txt08_intents", f"SELECT question_id, intent, confidence, array_to_string(entities, ';') AS entities FROM {ANALYSED_SQL} a")
def _(spark, sf):
    return rounded(Q.analyse(_all_questions(spark, sf), CONNECTIONS).select("question_id", "intent", "confidence", "entities"))


_FIELDS = "CASE intent " + " ".join(f"WHEN '{i}' THEN '{';'.join(f)}'" for i, f in S.INTENT_FIELDS.items()) + f" ELSE '{';'.join(CONNECTIONS.essential_columns)}' END"


@query("txt09_search_fields", f"SELECT question_id, {_FIELDS} AS search_fields FROM {ANALYSED_SQL} a")
def _(spark, sf):
    return rounded(Q.analyse(_all_questions(spark, sf), CONNECTIONS).select("question_id", "search_fields"))


# --- patterns ----------------------------------------------------------------------------------------

def _meets(text: str) -> str:
    t = text.lower().replace("'", "''")
    return f"(contains(lower(question), '{t}') OR contains('{t}', lower(question)))"


def _score(p: S.Pattern) -> str:
    share = " + ".join(f"contains(lower(question), '{e.lower()}')::INT" for e in p.business_entities)
    samples = " OR ".join(_meets(s) for s in p.sample_queries)
    return f"CASE WHEN {_meets(p.question_pattern)} THEN 0.95 WHEN {samples} THEN 0.9 ELSE least(({share}) / {len(p.business_entities)}.0 * 0.4 + kw * 0.6, 0.85) END::DOUBLE"


def _keyword_share(spec) -> str:
    words = spec.all_intent_keywords
    return "(" + " + ".join(f"contains(lower(question), '{w.lower()}')::INT" for w in words) + f") / {len(words)}.0"


def _best_sql(spec) -> str:
    union = " UNION ALL ".join(
        f"SELECT question_id, {i} AS place, '{p.answer_intent}' AS intent, round({_score(p)}, 6) AS score FROM k" for i, p in enumerate(spec.patterns))
    return f"""WITH k AS (SELECT *, {_keyword_share(spec)} AS kw FROM {ALL_SQL} q), s AS ({union}),
b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, place) AS n FROM s WHERE score >= 0.7)"""


@query("txt10_best_pattern", f"{_best_sql(TECH_DETAILS)} SELECT k.question_id, b.intent, b.score FROM k LEFT JOIN b ON b.question_id = k.question_id AND n = 1")
def _(spark, sf):
    matched = PT.match_patterns(_all_questions(spark, sf), TECH_DETAILS)
    return rounded(matched.select("question_id", F.col("match.answer_intent").alias("intent"), F.col("match.score").alias("score")), 6)


@query("txt11_connection_pattern", f"{_best_sql(CONNECTIONS)} SELECT k.question_id, b.intent, b.score FROM k LEFT JOIN b ON b.question_id = k.question_id AND n = 1")
def _(spark, sf):
    matched = PT.match_patterns(_all_questions(spark, sf), CONNECTIONS)
    return rounded(matched.select("question_id", F.col("match.answer_intent").alias("intent"), F.col("match.score").alias("score")), 6)


# Stored patterns: one per nation, with the entities of its questions.
_STORED_SQL = "(SELECT n_nationkey, 'find connections on ' || n_name AS question_pattern, 'by_' || lower(n_name) AS intent, n_nationkey / 100.0 AS confidence FROM nation)"


def _stored(spark, sf):
    return table(spark, sf, "nation").select(
        F.concat(F.lit("find connections on "), "n_name").alias("question_pattern"), F.concat(F.lit("by_"), F.lower("n_name")).alias("answer_intent"),
        F.array().cast("array<string>").alias("samples"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("expected_columns"),
        F.lit("").alias("search_strategy"), (F.col("n_nationkey") / 100.0).alias("confidence_score"),
    )


_STORED_MATCH = f"""WITH q AS (SELECT * FROM {ALL_SQL} x), b AS (SELECT q.question_id, p.intent, row_number() OVER (PARTITION BY q.question_id ORDER BY p.confidence DESC, p.question_pattern) AS n
  FROM q JOIN {_STORED_SQL} p ON contains(lower(q.question), lower(p.question_pattern)) OR contains(lower(p.question_pattern), lower(q.question)))
SELECT q.question_id, b.intent FROM q LEFT JOIN b ON b.question_id = q.question_id AND n = 1"""
_ONLY_STORED = S.CollectionSpec("stored")


@query("jon08_stored_patterns", _STORED_MATCH)
def _(spark, sf):
    matched = PT.match_patterns(_all_questions(spark, sf), _ONLY_STORED, stored=_stored(spark, sf))
    return matched.select("question_id", F.col("match.answer_intent").alias("intent"))


@query("jon08_stored_patterns_in_chunks", _STORED_MATCH)
def _(spark, sf):
    matched = PT.match_patterns(_all_questions(spark, sf), _ONLY_STORED, stored=_stored(spark, sf))
    return matched.select("question_id", F.col("match.answer_intent").alias("intent"))


def _when_any(groups) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_any(w)} THEN '{n}' END" for n, w in groups.items()) + "], lambda x: x IS NOT NULL)"


@query("txt12_intents_mentioned", f"SELECT question_id, array_to_string({_when_any(TECH_DETAILS.intent_keywords)}, ';') AS intents FROM {ALL_SQL} q")
def _(spark, sf):
    return rounded(_all_questions(spark, sf).select("question_id", PT.intents_mentioned(F.col("question"), TECH_DETAILS.intent_keywords).alias("intents")))


def _expanded_sql() -> str:
    text = "question"
    steps = []
    for i, (term, words) in enumerate((t, w) for t, ws in TECH_DETAILS.aliases.items() for w in ws):
        steps.append(f"s{i + 1} AS (SELECT *, CASE WHEN contains(lower(question), '{term.lower()}') AND NOT contains(lower(t{i}), '{words.lower()}') THEN t{i} || ' {words}' ELSE t{i} END AS t{i + 1} FROM s{i})")
    return f"WITH s0 AS (SELECT question_id, question, {text} AS t0 FROM {ALL_SQL} q), {', '.join(steps)} SELECT question_id, t{len(steps)} AS expanded FROM s{len(steps)}"


@query("txt13_expanded", _expanded_sql())
def _(spark, sf):
    return _all_questions(spark, sf).select("question_id", PT.expanded(F.col("question"), TECH_DETAILS.aliases).alias("expanded"))


_RELEVANT = "list_filter([" + ", ".join(
    f"CASE WHEN {_any(e.keywords)} THEN '{e.column}:{e.relevance}' END" for e in TECH_DETAILS.dictionary if e.include_in_context and e.keywords) + "], lambda x: x IS NOT NULL)"


@query("txt14_relevant_columns", f"SELECT question_id, array_to_string({_RELEVANT}, ';') AS columns FROM {ALL_SQL} q")
def _(spark, sf):
    found = PT.relevant_columns(F.col("question"), TECH_DETAILS)
    return rounded(_all_questions(spark, sf).select("question_id", F.transform(found, lambda c: F.concat_ws(":", c["name"], c["relevance"])).alias("columns")))


@query("txt15_query_features", f"""
SELECT question_id, len(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')) AS word_count, regexp_matches(question, '\\p{{Nd}}') AS has_numbers,
  {_any(S.DATE_WORDS)} AS has_dates, array_to_string({_present(S.BUSINESS_TERMS)}, ';') AS business, array_to_string({_present(S.TECHNICAL_TERMS)}, ';') AS technical FROM {ALL_SQL} q""")
def _(spark, sf):
    f = F.col("f")
    rows = _all_questions(spark, sf).select("question_id", Q.query_features(F.col("question")).alias("f"))
    return rounded(rows.select(
        "question_id", f["word_count"].alias("word_count"), f["has_numbers"].alias("has_numbers"), f["has_dates"].alias("has_dates"),
        f["business_keywords"].alias("business"), f["technical_keywords"].alias("technical"),
    ))


# --- schema search -----------------------------------------------------------------------------------

_SEARCH_SQL = f"""
WITH a AS (SELECT * FROM {ANALYSED_SQL} x), d AS (SELECT * FROM {CONNECTIONS_SQL} x),
p AS (SELECT a.*, d.*, (emsn IS NULL AND mpan IS NULL AND mprn IS NULL AND uprn IS NULL AND len(postcodes) = 0 AND street IS NULL) AS bare FROM a JOIN d
  ON (a.emsn IS NULL OR list_contains(d.EMSN_, a.emsn)) AND (a.mpan IS NULL OR list_contains(d.MPAN_, a.mpan)) AND (a.mprn IS NULL OR list_contains(d.MPRN_, a.mprn))
  AND (a.uprn IS NULL OR list_contains(d.UPRN_, a.uprn)) AND (len(a.postcodes) = 0 OR len(list_filter(a.postcodes, lambda z: starts_with(upper(d.POSTCODE_[1]), z))) > 0)
  AND (a.street IS NULL OR contains(upper(d.ADDRESS_[1]), a.street))
  AND (NOT (emsn IS NULL AND mpan IS NULL AND mprn IS NULL AND uprn IS NULL AND len(postcodes) = 0 AND street IS NULL) OR number IS NULL OR list_contains(d.UPRN_, number))),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY _id) AS n FROM p)
SELECT question_id, _id AS doc, intent, confidence, {_FIELDS} AS search_fields, round(least(1.0, confidence * 0.4
  + 0.3 * ((emsn IS NOT NULL)::INT + (mpan IS NOT NULL)::INT + (mprn IS NOT NULL)::INT + (uprn IS NOT NULL)::INT)
  + 0.2 * len(list_filter(postcodes, lambda z: contains(lower(POSTCODE_[1]), lower(z)))) + 0.2 * coalesce(contains(lower(ADDRESS_[1]), lower(street)), false)::INT
  + 0.1 * len(list_filter(entities, lambda e: contains(lower(array_to_string(UPRN_, chr(10)) || chr(10) || array_to_string(EMSN_, chr(10)) || chr(10) || array_to_string(MPAN_, chr(10)) || chr(10)
    || array_to_string(MPRN_, chr(10)) || chr(10) || array_to_string(POSTCODE_, chr(10)) || chr(10) || array_to_string(ADDRESS_, chr(10))), lower(e)))))::DOUBLE, 6) AS relevance
FROM r WHERE n <= 20"""
for _f in ("EMSN", "MPAN", "MPRN", "UPRN", "POSTCODE", "ADDRESS"):
    _SEARCH_SQL = _SEARCH_SQL.replace(f" AS {_f}, ", f" AS {_f}_, ").replace(f" AS {_f},\n", f" AS {_f}_,\n")


def _searched(spark, sf):
    return schema_search(_all_questions(spark, sf), connections(spark, sf), CONNECTIONS)


@query("txt18_schema_search", _SEARCH_SQL)
def _(spark, sf):
    return rounded(_searched(spark, sf).select(
        "question_id", "doc", F.col("context.intent").alias("intent"), F.col("context.confidence").alias("confidence"), "search_fields", "relevance"
    ), 6)


@query("txt16_relevance", f"SELECT question_id, doc, relevance FROM ({_SEARCH_SQL})")
def _(spark, sf):
    return _searched(spark, sf).select("question_id", "doc", "relevance")


@query("txt17_result_context", f"SELECT question_id, doc, intent, confidence FROM ({_SEARCH_SQL})")
def _(spark, sf):
    return _searched(spark, sf).select("question_id", "doc", F.col("context.intent").alias("intent"), F.col("context.confidence").alias("confidence"))


def _enhance_sql(spec) -> str:
    expected = " ".join(f"WHEN '{p.answer_intent}' THEN '{';'.join(p.expected_columns)}'" for p in spec.patterns)
    return f"""
{_best_sql(spec)}, m AS (SELECT k.*, b.intent AS matched, b.score FROM k LEFT JOIN b ON b.question_id = k.question_id AND n = 1),
i AS (SELECT *, list_concat(CASE WHEN matched IS NOT NULL THEN [matched] ELSE [] END, {_when_any(spec.intent_keywords)}, {_when_any(spec.question_words)}) AS names FROM m)
SELECT question_id, coalesce(score, 0) AS confidence_score, array_to_string(list_sort(list_distinct(names)), ';') AS intents,
  CASE WHEN len(names) > 0 THEN 'semantic_search' ELSE 'vector_search' END AS search_strategy, CASE matched {expected} ELSE '' END AS expected FROM i"""


def _enhanced(spark, sf, spec):
    enhanced = PT.enhance(_all_questions(spark, sf), spec)
    expected = F.transform(F.filter("relevant_columns", lambda c: F.array_contains(F.col("match.expected_columns"), c["name"])), lambda c: c["name"])
    return rounded(enhanced.select("question_id", "confidence_score", F.array_sort("detected_intent").alias("intents"), "search_strategy", expected.alias("expected")), 6)


@query("txt19_enhance", _enhance_sql(TECH_DETAILS))
def _(spark, sf):
    return _enhanced(spark, sf, TECH_DETAILS)


@query("txt19_enhance_connections", _enhance_sql(CONNECTIONS))
def _(spark, sf):
    return _enhanced(spark, sf, CONNECTIONS)


@query("txt14_columns_of_connections", f"""
{_best_sql(CONNECTIONS)} SELECT k.question_id, CASE b.intent {' '.join(f"WHEN '{p.answer_intent}' THEN '{';'.join(p.expected_columns)}'" for p in CONNECTIONS.patterns)} ELSE '' END AS columns
FROM k LEFT JOIN b ON b.question_id = k.question_id AND n = 1""")
def _(spark, sf):
    """No column of this collection is described for context, so only those of the matched pattern are relevant."""
    found = PT.enhance(_all_questions(spark, sf), CONNECTIONS)
    return rounded(found.select("question_id", F.transform("relevant_columns", lambda c: c["name"]).alias("columns")))


# Asked names: the part names with their first letter lost; known names: those of brand and type as well.
@query("txt20_fuzzy_names", """
WITH a AS (SELECT DISTINCT substr(p_name, 3) AS name FROM part), k AS (SELECT DISTINCT p_name AS known FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT p_type FROM part),
s AS (SELECT name, known, len(list_filter(string_split(name, ''), lambda c: contains(known, c))) * 1.0 / greatest(len(name), len(known)) AS share,
  len(list_filter(string_split(lower(name), ''), lambda c: contains(lower(known), c))) * 1.0 / greatest(len(name), len(known)) AS low FROM a, k),
t AS (SELECT name, known, round(CASE WHEN contains(lower(known), lower(name)) OR contains(lower(name), lower(known)) THEN 2.0 WHEN share > 0.7 THEN share + 1 ELSE low END::DOUBLE, 9) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, known) AS n FROM t)
SELECT name, CASE WHEN score > 0.5 THEN known END AS suggestion, CASE WHEN score > 0.5 THEN score END AS score FROM r WHERE n = 1""")
def _(spark, sf):
    part = table(spark, sf, "part")
    asked = part.select(F.substring("p_name", 3, 1000).alias("name"))
    known = part.select(F.col("p_name").alias("name")).union(part.select("p_brand")).union(part.select("p_type"))
    return PT.match_names(asked, known)


# Code texts: one per event, with fences, comments and a risky call now and then.
_CODE = """CASE event_type
  WHEN 'error' THEN '```python' || chr(10) || 'import os' || chr(10) || 'df1[' || chr(39) || 'value' || chr(39) || '].sum()' || chr(10) || '```'
  WHEN 'click' THEN 'df1[' || chr(39) || 'ratio' || chr(39) || '] = df1[' || chr(39) || 'value' || chr(39) || '] / 2' || chr(10) || 'result = df1[' || chr(39) || 'ratio' || chr(39) || '].mean()  # eval(x)'
  WHEN 'view' THEN 'result = df2[' || chr(39) || 'k_' || CAST(user_id AS STRING) || chr(39) || ']' || chr(10) || 'open("a")'
  ELSE 'result = df1[' || chr(39) || 'filtered_rows' || chr(39) || '].count()' END"""
_CODE_SQL = f"(SELECT event_id, {_CODE} AS code FROM events)"


def _codes(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(_CODE).alias("code"))


@query("txt21_without_fences", f"""
SELECT event_id, CASE WHEN starts_with(code, '```') THEN 'import os' || chr(10) || 'df1[''value''].sum()' ELSE code END AS code FROM {_CODE_SQL} c""")
def _(spark, sf):
    return _codes(spark, sf).select("event_id", A.without_fences(F.col("code")).alias("code"))


@query("txt22_risk_counts", """
SELECT 'import' AS rule, count(*) AS rows FROM events WHERE event_type = 'error' UNION ALL SELECT 'open', count(*) FROM events WHERE event_type = 'view'""")
def _(spark, sf):
    return A.risk_counts(_codes(spark, sf), "code")


@query("txt23_unknown_names", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'k_' || CAST(user_id AS STRING) ELSE '' END AS bad_columns, CASE WHEN event_type = 'view' THEN 'df2' ELSE '' END AS bad_frames FROM events""")
def _(spark, sf):
    code = F.col("code")
    return rounded(_codes(spark, sf).select("event_id", A.unknown_columns(code, ["value"]).alias("bad_columns"), A.unknown_frames(code, ["df1"]).alias("bad_frames")))


@query("txt24_question_flags", f"SELECT question_id, length(trim(question, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 8 AS too_short, {_any(['error', 'emsn'])} AS names_column FROM {ALL_SQL} q")
def _(spark, sf):
    q = F.col("question")
    return _all_questions(spark, sf).select("question_id", Q.too_short(q).alias("too_short"), Q.mentions_column(q, ["Error", "EMSN"]).alias("names_column"))


