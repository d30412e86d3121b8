"""Quality rules per document, judged together per host. Column expressions only.

``document_rules`` computes the base measures of a text in its own row, without a shuffle. Failures are summed
per host, the hosts' failure rates are shrunk towards their common mean by a beta prior fitted by moments over all
hosts, and the verdict of the host goes back to its documents.

Edge cases: a null text has no words and fails; a null host is a host of its own; an empty table gives an
empty result; with fewer than two hosts, or no spread among them, the prior holds the common rate with
the weight of ``_MOST_PRIOR`` documents; repeated rows count each; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import WORD_GAP, words_of
from emberlake.session import stage

_SYMBOLS = "#*$%&|<>"
#: The prior weighs at most as much as so many documents.
_MOST_PRIOR = 1000.0
#: A host is refused if more than this share of its documents fail, after shrinking.
HOST_LIMIT = 0.5


def _with_repeat_words(rows: DataFrame) -> DataFrame:
    """``rows`` with ``n_repeat_words``: how many words lie in three-word windows that occur twice or more.

    Hashes of all windows tell whether any repeats. Only then are the windows sorted together with their places:
    a window equal to a neighbour in that order repeats, and its words are those from its place
    up to the next repeated window's, three at most. Each array is a column of its own, as a lambda would compute an
    expression from outside anew for every element.
    """
    size = F.greatest(F.size("words") - 2, F.lit(0))
    word = lambda i: F.get("words", i)
    rows = rows.withColumn("hashes", F.transform(F.slice("words", 1, size), lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2))))
    sorted_ = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))
    rows = rows.withColumn("places", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), sorted_))
    place = lambda k: F.get("places", k)["h"]
    alike = F.transform("places", lambda p, k: F.when((place(k - 1) == p["h"]) | (place(k + 1) == p["h"]), p["i"]))
    covered = F.aggregate(
        F.sort_array(F.filter(alike, lambda i: i.isNotNull())),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
    )["n"]
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def document_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """``(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)`` per row."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(host_column).alias("host"), text.alias("text"))
    rows = _with_repeat_words(rows.withColumn("words", words_of(F.col("text"))))
    n_words = F.size("words").cast("long")
    lines = F.filter(F.split("text", "\n"), lambda line: F.regexp_replace(line, WORD_GAP, "") != "")
    rows = rows.select(
        "doc_id", "host", n_words.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(rules: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``(host, n_docs, n_failed, shrunk_rate, host_kept)``.

    With rates ``x = failed / docs`` the prior's mean is the common rate ``m``; its weight ``s`` solves
    ``var = m (1 - m) / (s + 1)`` for the variance between hosts, less what chance alone gives each host.
    """
    hosts = rules.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    x = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.count("*").alias("k"), F.sum(F.lit(1) / F.col("n_docs")).alias("r"),
        F.var_samp(x).alias("v"),
    ).first()  # one row of five numbers
    mean = moments["f"] / moments["n"] if moments["n"] else 0.0
    spread = mean * (1 - mean)
    chance = spread * (moments["r"] / moments["k"]) if moments["k"] else 0.0
    between = (moments["v"] or 0.0) - chance
    weight = min(_MOST_PRIOR, max(1.0, spread / between - 1)) if between > 0 else _MOST_PRIOR
    shrunk = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= limit).alias("host_kept"))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """``document_rules`` with the host's verdict, its shrunk rate and ``kept``."""
    rules = stage(document_rules(docs, id_column, text_column, host_column), "rules")
    verdicts = host_verdicts(rules, limit).select(F.col("host").alias("of_host"), "shrunk_rate", "host_kept")
    # Spark broadcasts the verdicts if they are small, and splits a host that holds much of the rows if not.
    joined = rules.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True)))


def op3_host_rules(spark, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = """
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text,
    [w FOR w IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t),
windows AS (SELECT doc_id, i, words[i:i + 2] AS w FROM places),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM repeated) GROUP BY doc_id),
base AS (SELECT t.doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'gs'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, [l FOR l IN string_split(text, chr(10)) IF regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g') <> ''] AS lines FROM t) t
  LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT host, count(*) AS nd, sum(base_failed::BIGINT) AS nf FROM judged GROUP BY host),
moments AS (SELECT sum(nf) / sum(nd) AS m, avg(1 / nd) AS r, coalesce(var_samp(nf / nd), 0) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v - m * (1 - m) * r > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / (v - m * (1 - m) * r) - 1)) ELSE 1000.0 END AS s FROM moments),
verdicts AS (SELECT host, (nf + m * s) / (nd + s) <= 0.5 AS host_kept FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM judged JOIN verdicts ON judged.host IS NOT DISTINCT FROM verdicts.host
"""
