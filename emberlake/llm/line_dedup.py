"""Line deduplication by an exact set-similarity join. DataFrame functions only.

A line is the set of its words. A line is removed if an earlier one (by document id, then place) has a Jaccard
similarity of ``percent`` hundredths or more with it; both count as they stand in the input. Lines with equal sets are
first reduced to the earliest. Of each set the words are put in order of rarity and the first ``n - ceil(t n) + 1`` are
its prefix: similar sets share a word there. Pairs that meet in a prefix pass the length filter, the positional filter
(what may still overlap after the two places must reach the needed overlap), a filter by 256-bit maps of the words (each
bit in which two maps differ is a word that the sets do not share; 64 bits are full from some hundred words on) and one by the number of
words that their prefixes share, and are verified on their words.

Rarity comes from a table of ``BUCKETS`` word counts over all lines; its size does not grow with the data. Any order
that is the same for all lines gives the exact join; rarity only keeps the posting lists short. Inside a line a word is known by the
magnitude of its count and 58 bits of its hash, equal sets by 128 bits of those, in lists a word is known by 32 bits; every pair that
the lists give is compared on the words themselves.

So that many variants of one line are not paired with each other, each set first meets, by its rarest words, only the earliest
set of about its length; sets removed that way no longer ask, and only the others meet whole lists. The result names one earlier
line for each line to remove, not all that are like it.

Edge cases: null and empty texts have no lines; lines without a word never match and stay; equal lines within one
document count as repeats; rows that share an id count as one document, whose lines at one place go together; an
empty table gives an empty result; rows without an id are left as they are; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import WORD_GAP
from emberlake.session import scratch, stage

PERCENT = 80
BUCKETS = 1 << 16
#: Rows of the table that tells which lines' texts are to be fetched.
SLOTS = 1 << 18
#: How many words of a prefix the first, cheap round looks at.
_RAREST = 2
#: The columns of a set's map of words, 64 bits each.
_MAP = ("bits", "bits1", "bits2", "bits3")
#: What separates words besides the space.
_GAPS = "\t\x0b\x0c\r"


def lines_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, place, line)``: the lines with a word, with plain spaces and trimmed; places count from 0 over all lines of a text."""
    text = F.col(text_column)
    for gap in _GAPS:
        text = F.replace(text, F.lit(gap), F.lit(" "))
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    return rows.withColumn("line", F.trim("line")).where("line <> ''")


def _words(line: str) -> Column:
    """The words of a line from ``lines_of``, perhaps with empty ones between."""
    return F.split(line, " ")


def _magnitudes(lines: DataFrame) -> Column:
    """The binary magnitude of how often the words of each bucket occur, as one constant array of ``BUCKETS`` numbers."""
    word = lines.select(F.explode(_words("line")).alias("word"))
    counts = word.groupBy(F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n")).collect()
    table = [0] * BUCKETS
    for row in counts:
        table[row["bucket"]] = min(31, row["n"].bit_length())
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")


def _needed(n: Column, percent: int) -> Column:
    """``ceil(n * percent / 100)``"""
    return F.floor((n * percent + 99) / 100).cast("int")


def _sets(lines: DataFrame, percent: int) -> DataFrame:
    """Every line with its set's size, its earliest equal, and, if it is that itself, its prefix."""
    magnitudes = _magnitudes(lines)
    empty = F.xxhash64(F.lit(""))
    rows = lines.select("doc_id", "place", F.array_remove(F.array_distinct(F.transform(_words("line"), lambda w: F.xxhash64(w))), empty).alias("hashes"))
    key = lambda h: F.shiftleft(F.get(magnitudes, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), 58).bitwiseOR(F.shiftrightunsigned(h, 6))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = lambda h: F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))
    part = lambda i: F.aggregate("hashes", none, lambda bits, h: bits.bitwiseOR(F.when(F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(len(_MAP) - 1)) == i, bit(h)).otherwise(none)))
    rows = rows.select("doc_id", "place", F.size("hashes").alias("n"), *[part(i).alias(name) for i, name in enumerate(_MAP)], F.sort_array(F.transform("hashes", key)).alias("keys"))
    prefix = F.transform(F.slice("keys", 1, F.col("n") - _needed(F.col("n"), percent) + 1), lambda k: F.shiftrightunsigned(F.shiftleft(k, 32), 32) - 2**31)
    rows = rows.select("doc_id", "place", "n", *_MAP, F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2"), prefix.cast("array<int>").alias("prefix"))
    equal = Window.partitionBy("h1", "h2").orderBy("doc_id", "place")
    rows = rows.withColumns({"first_doc": F.first("doc_id").over(equal), "first_place": F.first("place").over(equal), "nth": F.row_number().over(equal)})
    return rows.select("doc_id", "place", "n", *_MAP, "first_doc", "first_place", F.when(F.col("nth") == 1, F.col("prefix")).alias("prefix"))


def _wanted(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines that ``ids (doc_id, place)`` name and few others: a table of at most ``SLOTS`` words of 64 bits lets them through.

    So the text of lines that have no partner is not shuffled. A full table lets every line through, and joins on the ids follow.
    """
    hashed = F.xxhash64("doc_id", "place")
    slot, bit = hashed.bitwiseAND(F.lit(SLOTS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 58).cast("int"))
    marks = ids.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("marks"))
    # The hint is on a table of at most SLOTS rows of two numbers.
    return lines.withColumn("slot", slot).join(F.broadcast(marks), "slot").where(F.col("marks").bitwiseAND(bit) != 0).select("doc_id", "place", "line")


def _placed(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lines of ``pairs (doc_id, place, other_doc, other_place)``, dealt out by document and place; the joins of a job read one exchange."""
    ids = pairs.select("doc_id", "place").unionByName(pairs.select(F.col("other_doc").alias("doc_id"), F.col("other_place").alias("place")))
    return _wanted(lines, ids).repartition("doc_id", "place")


def _verified(pairs: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Per line of ``pairs (doc_id, place, other_doc, other_place)`` the earliest other that is similar enough by its words in ``placed``."""
    theirs = placed.select(F.col("doc_id").alias("other_doc"), F.col("place").alias("other_place"), F.col("line").alias("other_line"))
    both = pairs.join(theirs, ["other_doc", "other_place"]).join(placed, ["doc_id", "place"])
    # In a plain condition each mention of an array would split its line again; the fields of a lambda's argument are made once.
    # Intersection and union have each word once; what a double space leaves between the words is no word.
    each = F.array(F.struct(_words("line").alias("a"), _words("other_line").alias("b")))
    count = lambda words: F.size(F.array_remove(words, ""))
    similar = both.where(F.exists(each, lambda x: 100 * count(F.array_intersect(x["a"], x["b"])) >= percent * count(F.array_union(x["a"], x["b"]))))
    return similar.groupBy("doc_id", "place").agg(F.min(F.struct("other_doc", "other_place")).alias("o"))


def matches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """``(doc_id, place, other_doc, other_place)`` of every line to remove, with an earlier line like it.

    Every step is staged, so that no two of their exchanges lie on disk together.
    """
    lines = lines_of(docs, id_column, text_column)
    sets = stage(_sets(lines, percent), "line-sets")
    equal = sets.where("doc_id <> first_doc or place <> first_place").select("doc_id", "place", F.col("first_doc").alias("other_doc"), F.col("first_place").alias("other_place"))
    # None of the columns is null; said here, so that no join adds such a test to one side only and keeps it from sharing an exchange.
    known = " and ".join(f"{c} is not null" for c in ("prefix", "doc_id", "place", "n", *_MAP))
    firsts = sets.where(known).select("doc_id", "place", "n", *_MAP, "prefix")

    # By their rarest words sets of about one size (bands a quarter apart) meet the earliest one.
    rarest = firsts.select("doc_id", "place", "n", *_MAP, F.posexplode(F.slice("prefix", 1, _RAREST)).alias("at", "word"))
    rarest = rarest.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int"))
    lists = Window.partitionBy("word", "band").orderBy("doc_id", "place")
    earliest = {name: F.first(column).over(lists) for name, column in (("other_doc", "doc_id"), ("other_place", "place"), ("m", "n"), ("other_at", "at"), *((f"other_{b}", b) for b in _MAP))}
    first_pairs = stage(_filtered(rarest.withColumns(earliest), percent), "line-pairs")
    near = stage(_verified(first_pairs, _placed(lines, first_pairs), percent), "line-near")

    # Those not removed so far ask all earlier sets of their lists; both sides read one exchange. A set that asks no more has its
    # size negative.
    listed = firsts.join(near.select("doc_id", "place", F.lit(-1).alias("sign")), ["doc_id", "place"], "left")
    listed = listed.select("doc_id", "place", (F.col("n") * F.coalesce("sign", F.lit(1))).alias("n"), *_MAP, F.posexplode("prefix").alias("at", "word")).repartition("word")
    others = listed.select("word", *[F.col(c).alias(f"other_{c}") for c in ("doc_id", "place", "n", "at", *_MAP)])
    others = others.withColumnsRenamed({"other_doc_id": "other_doc", "other_n": "m"})
    # The sign is tested on joined rows: before the join the test would give the sides plans of their own, and so two exchanges.
    met = listed.join(others, "word").where(F.col("n") * F.abs("m") > 0).withColumn("m", F.abs("m"))
    pairs = stage(_counted(met, percent), "line-pairs")
    # Of many earlier lines like it a line first meets the one with which it shares most; the others only if that is none.
    placed = _placed(lines, pairs)
    closest = pairs.groupBy("doc_id", "place").agg(F.min(F.struct(-F.col("shared"), "other_doc", "other_place")).alias("c")).select("doc_id", "place", "c.other_doc", "c.other_place")
    soon = _verified(closest, placed, percent)
    late = _verified(pairs.drop("shared").join(soon.select("doc_id", "place"), ["doc_id", "place"], "left_anti"), placed, percent)
    found = near.unionByName(soon).unionByName(late).select("doc_id", "place", "o.other_doc", "o.other_place")
    return equal.unionByName(found)


def _possible(percent: int) -> tuple[Column, Column]:
    """What a pair of sets must fulfil by order, sizes and word maps alone, and the overlap that it needs."""
    earlier = (F.col("other_doc") < F.col("doc_id")) | ((F.col("other_doc") == F.col("doc_id")) & (F.col("other_place") < F.col("place")))
    lengths = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    # Overlap o gives a similarity of o / (n + m - o).
    needed = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    differing = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"other_{b}"))) for b in _MAP[1:]), F.bit_count(F.col(_MAP[0]).bitwiseXOR(F.col(f"other_{_MAP[0]}"))))
    return earlier & lengths & (differing <= F.col("n") + F.col("m") - 2 * needed), needed


def _filtered(met: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of a set with an earlier one that can be similar, given one common word: from it on the sets may still share the rest."""
    possible, needed = _possible(percent)
    position = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("other_at")) >= needed
    return met.where(possible & position).select("doc_id", "place", "other_doc", "other_place").distinct()


def _counted(met: DataFrame, percent: int) -> DataFrame:
    """Pairs that can be similar, given all common words of their prefixes, with the number of these.

    A common word leaves out what only one of the sets can have on each side of it. The prefix that ends first in the order of
    words has all common words up to its end; behind it lie at most ``ceil(t n) - 1``.
    """
    possible, needed = _possible(percent)
    n, m, at, other_at = (F.col(c) for c in ("n", "m", "at", "other_at"))
    position = F.least(at, other_at) + F.least(n - at, m - other_at) >= needed
    pair = ["doc_id", "place", "other_doc", "other_place"]
    counted = met.where(possible & position).groupBy(*pair).agg(F.count("*").cast("int").alias("shared"), F.min("n").alias("n"), F.min("m").alias("m"))
    behind = F.greatest(_needed(n, percent), _needed(m, percent)) - 1
    return counted.where(F.col("shared") + behind >= needed).select(*pair, "shared")


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without the lines that ``matches`` names; a document that loses all its lines keeps an empty text."""
    with scratch(docs.sparkSession) as keep:
        gone = keep(matches(docs, id_column, text_column, percent).groupBy(F.col("doc_id").alias("__gone_id")).agg(F.collect_set("place").alias("__gone")), "gone-lines")
    joined = docs.join(gone, docs[id_column] == F.col("__gone_id"), "left").withColumn("__lines", F.split(text_column, "\n"))
    joined = joined.withColumn("__kept", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone")))
    text = F.array_join(F.transform("__kept", lambda p: F.get("__lines", p)), "\n")
    return joined.withColumn(text_column, F.when(F.col("__gone").isNull(), F.col(text_column)).otherwise(text)).select(*docs.columns)


def op8_lines(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.col("place").cast("long").alias("line_no"))


OP8_SQL = """
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
w AS (SELECT doc_id, line_no, list_sort(list_distinct([x FOR x IN string_split_regex(line, '[\\x20\\x09-\\x0D]+') IF x <> ''])) AS s FROM l),
s AS (SELECT * FROM w WHERE len(s) > 0),
first AS (SELECT s, min((doc_id, line_no)) AS id, len(s) AS n FROM s GROUP BY s),
df AS (SELECT tok, count(*) AS c FROM (SELECT unnest(s) AS tok FROM first) GROUP BY tok),
ranked AS (SELECT id, n, tok, row_number() OVER (PARTITION BY id ORDER BY c, tok) AS k FROM (SELECT id, n, unnest(s) AS tok FROM first) JOIN df USING (tok)),
p AS (SELECT id, n, tok FROM ranked WHERE k <= n - (n * 80 + 99) // 100 + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.tok = b.tok AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
near AS (SELECT DISTINCT b AS id FROM (SELECT c.b, len(list_intersect(x.s, y.s)) AS o, x.n + y.n AS t FROM c JOIN first x ON x.id = c.a JOIN first y ON y.id = c.b) WHERE 100 * o >= 80 * (t - o))
SELECT doc_id, line_no::BIGINT AS line_no FROM s JOIN first USING (s) WHERE (doc_id, line_no) <> id
UNION ALL SELECT id[1], id[2]::BIGINT FROM near
"""
