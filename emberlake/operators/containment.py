"""Which texts contain which others, without comparing all pairs.

Every longer text is listed under its pieces of up to three letters. A sought text is looked up under one of its pieces only,
the one that the fewest texts hold; what meets there is compared letter by letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.session import stage

PIECE = 3


def _pieces(letters: Column, size: int) -> Column:
    """All pieces of ``size`` letters, none if the text is shorter."""
    starts = F.when(F.size(letters) >= size, F.sequence(F.lit(0), F.size(letters) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(letters, i + 1, F.lit(size)), ""))


def _with_letters(texts: DataFrame, name: str) -> DataFrame:
    return texts.where(F.col(name).isNotNull() & (F.col(name) != "")).select(name).distinct().withColumn("letters", F.filter(F.split(name, ""), lambda c: c != ""))


def contained_pairs(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """``part, whole``: all pairs of texts of ``parts (part)`` and ``wholes (whole)`` in which the whole contains the part.

    Empty and null texts are in no pair; repeated ones count once.
    """
    letters = F.col("letters")
    own = F.when(F.size("letters") >= PIECE, _pieces(letters, PIECE)).otherwise(F.array(F.col("part")))
    sought = stage(_with_letters(parts, "part").select("part", F.explode(F.array_distinct(own)).alias("piece")), "sought")
    known = _with_letters(wholes, "whole").withColumn("whole_id", F.xxhash64("whole"))
    listed = known.select("whole_id", F.explode(F.array_distinct(F.concat(*[_pieces(letters, n) for n in range(1, PIECE + 1)]))).alias("piece"))
    listed = stage(listed.join(sought.select("piece").distinct(), "piece", "left_semi"), "pieces")
    counts = listed.groupBy("piece").agg(F.count("*").alias("n"))
    # A piece that no text holds has no count: its part is in no text.
    rarest = sought.join(counts, "piece", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("k")).where("k.n > 0")
    met = rarest.select("part", F.col("k.piece").alias("piece")).join(listed, "piece").select("part", "whole_id")
    return met.join(known.select("whole_id", "whole"), "whole_id").where(F.contains("whole", "part")).select("part", "whole")
