"""Near-duplicate documents by SimHash: positional byte index, count filter, verification.

A document's fingerprint has 64 bits; a bit is 1 if it is set in more than half of the XXH64 values (seed
42) of the document's word shingles, repeats included. Two fingerprints link if at most ``max_bits`` bits
differ. Differing bits touch at most ``max_bits`` of the eight bytes, so linked fingerprints share at
least ``8 - max_bits`` bytes at their positions. The index therefore has a posting list for every choice
of positions among the first bytes together with the bytes found there; members of a posting list are
tallied (shared positional bytes), kept from the guaranteed minimum on, and verified by their bits.

Inside a posting list only a spanning forest of the verified links is given out, never all pairs. A list
longer than ``MAX_LIST`` is cut into blocks and each pair of blocks becomes a task of its own, so nothing
is dropped and no task holds an unbounded list.

Edge cases: null, empty and word-less texts have fingerprint zero and link like any other; fewer words
than a shingle count as one shingle; repeated rows share a fingerprint and so a component; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import connected_components, task_count
from emberlake.session import stage

SEED = 42
MAX_LIST = 20_000
_LIST_ROWS_PER_TASK = 400_000


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_of(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _postings(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``(list, fp)``: for every choice of positions, the choice's number with the bytes found there.

    Of the first seven bytes at least ``7 - max_bits`` agree; lists over that many positions find every link.
    """
    agree = 7 - max_bits
    choices = list(combinations(range(7), agree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(fps), 20_000):
                part = fps[at : at + 20_000]
                octets = part.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.uint64)
                for number, chosen in enumerate(choices):
                    key = np.full(len(part), number, dtype=np.uint64)
                    for position in chosen:
                        key = (key << np.uint64(8)) | octets[:, position]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part.view(np.int64))], names=["list", "fp"])

    return distinct.mapInArrow(run, "list long, fp long")


def _forest(left: np.ndarray, right: np.ndarray, least_bytes: int, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what is linked between ``left`` and ``right`` (unsigned fingerprints), as a forest.

    Searches breadth-first; a fingerprint that has been reached is not compared again, so a dense cluster costs
    little more than one pass over it.
    """
    same = left is right
    nodes = left if same else np.concatenate([left, right])
    side = np.zeros(len(nodes), dtype=bool)
    side[len(left) :] = True
    open_ = np.arange(len(nodes))
    links: list[tuple[int, int]] = []
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            node = queue.pop()
            others = open_ if same else open_[side[open_] != side[node]]
            xor = nodes[others] ^ nodes[node]
            near = np.bitwise_count(xor) <= max_bits
            found = others[near]
            if not len(found):
                continue
            tally = (xor[near].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            found = found[tally >= least_bytes]  # the count filter; links always pass it
            links += [(int(nodes[node]), int(nodes[x])) for x in found]
            queue += found.tolist()
            open_ = np.setdiff1d(open_, found, assume_unique=True)
    return links


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fp`` that connect exactly what is linked."""
    spark = distinct.sparkSession
    tasks = task_count(spark, distinct.count() * len(list(combinations(range(7), 7 - max_bits))), _LIST_ROWS_PER_TASK)
    lists = stage(_postings(distinct.select("fp"), max_bits), "postings")
    long_lists = lists.groupBy("list").count().where(F.col("count") > MAX_LIST).select("list", F.ceil(F.col("count") / MAX_LIST).cast("int").alias("parts"))
    dealt = lists.join(long_lists, "list", "left").withColumn("part", F.pmod(F.hash("fp"), F.coalesce("parts", F.lit(1))))
    # A member of block p meets every block q: the task of the pair (p, q) with p <= q gets both.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    dealt = dealt.select("list", "fp", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("list", "p", "q"), F.lit(tasks)).cast("int"))

    def run(rows: pa.Table) -> pa.Table:
        columns = [rows.column(c).to_numpy() for c in ("list", "p", "q", "part", "fp")]
        order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
        key, p, q, part, fp = (c[order] for c in columns)
        edge = np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
        starts, ends = np.r_[0, edge], np.r_[edge, len(key)]
        fp = fp.view(np.uint64)
        found: list[tuple[int, int]] = []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            if p[s] == q[s]:
                found += _forest(members := fp[s:e], members, 8 - max_bits, max_bits)
            else:
                cut = s + int(np.searchsorted(part[s:e], q[s]))
                found += _forest(fp[s:cut], fp[cut:e], 8 - max_bits, max_bits)
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        pairs = np.unique(pairs, axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return dealt.groupBy("task").applyInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """``(doc_id, fp, component_id)``: the fingerprint of each row and the least id that it reaches through links."""
    fps = stage(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(links(distinct, max_bits))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    firsts = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(labelled.join(firsts, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: int) -> DataFrame:
    """``docs`` with the row of the least id of each component; rows without an id are kept as they are."""
    found = near_duplicates(docs.where(F.col(id_column).isNotNull()), id_column, text_column, **options)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(gone, id_column, "left_anti").select(*docs.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
