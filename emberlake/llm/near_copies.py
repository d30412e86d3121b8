"""Near copies among documents: SimHash fingerprints, then exact Jaccard similarity of word shingles, and prefix lists for the rest.

Texts link if the sets of their five-word shingles (lower-case, XXH64, seed 42) have a Jaccard similarity of at
least four fifths. First candidates are the links of ``simhash``: fingerprints over the same shingles, lists by positional bytes, count
filter, at most ``MAX_BITS`` differing bits. Each is verified on its whole sets. Fingerprints of sets that are just similar enough
differ in some ten bits, which no byte lists find; for these there is an exact way. In any one order of the shingles, linked sets share a shingle among the first ``n - ceil(0.8 n) + 1``
of each; the order puts shingles that a sample shows to be frequent last, which changes the effort and no result. Lists of
shared prefix shingles give further candidates: first every member with the least of its list, then, where a list
still joins unlinked sets, the pairs across them. Every candidate is verified on its whole sets.

What a candidate must fulfil before whole sets are fetched leaves out no link: sizes; the places of the first shared shingle, behind which
the sets must still share the rest; and parity maps. A map has a bit for each residue of the shingles, 1 if an odd number of the
set's shingles has it, so each bit in which two maps differ is a shingle that the sets do not share. Maps have a bit for each shingle
at least; lists have them folded to ``BRIEF`` bits. Chance meetings end there, so that whole sets are fetched for few others than links.

Prefixes go to their lists packed, 20 bytes for each shingle, and a list knows a shingle by its residue and 32 bits; two shingles in one
list are further candidates and nothing else. Steps that nothing reads any more are removed.

Edge cases: null, empty and word-less texts have the empty set and link to each other; fewer words than a shingle count as
one shingle; equal sets are one node, known by 64 bits of its shingles; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm import simhash
from emberlake.llm.common import connected_components, task_count
from emberlake.session import scratch, stage

SEED = 42
SHINGLE = 5
#: A link needs ``LEAST[1] * shared >= LEAST[0] * all`` shingles.
LEAST = (4, 5)
#: Fingerprints that differ in more bits are left to the prefix lists.
MAX_BITS = 4
MAX_LIST = 2_000
#: The bits of the maps in lists, and of the smallest maps.
BRIEF = 1 << 10
#: Rows of the table that tells which texts are to be fetched.
SLOTS = 1 << 18
_SAMPLE_ROWS = 10_000
_FREQUENT = 10
_PAIRS_PER_TASK = 4_000_000
_MEMBERS_PER_TASK = 100_000
_PREFIX_ROWS_PER_TASK = 400_000
#: A prefix shingle on its way to its list: 32 bits of it, the set with its size, the place among the set's shingles.
_RECORD = np.dtype([("token", "<u4"), ("node", "<i8"), ("n", "<i4"), ("at", "<i4")])


def shingles_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle values of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends[:-1]]
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :])], dtype=np.uint64))


def _node(values: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(values.tobytes(), SEED), dtype=np.uint64).view(np.int64))


def _map(values: np.ndarray) -> bytes:
    """The parity map of a set: a power of two of bits, ``BRIEF`` and the set's size at least."""
    bits = max(BRIEF, 1 << (len(values) - 1).bit_length()) if len(values) else BRIEF
    counts = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The map of ``size`` bytes that the same set has; residues of a half are those of the whole, taken again."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many shingles sets of these sizes share at least if they link."""
    return -(-LEAST[0] * (n + m) // sum(LEAST))


def _may_link(n: np.ndarray, at: np.ndarray, m: np.ndarray, other_at: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can link if what stands at these places is the first shingle that they share."""
    needed = _needed(n, m)
    sizes = LEAST[1] * np.minimum(n, m) >= LEAST[0] * np.maximum(n, m)
    return sizes & (n - at >= needed) & (m - other_at >= needed)


def _frequent(texts: DataFrame) -> np.ndarray:
    """Shingles that many texts of a sample have, the rarer ones first."""
    rows = texts.count()
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // _SAMPLE_ROWS))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, dtype=np.uint64), *map(shingles_of, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["s"])

    counted = sample.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= _FREQUENT)
    found = counted.orderBy(F.desc("count"), "s").limit(1_000_000).toArrow()
    return found.column("s").to_numpy().view(np.uint64)[::-1].copy()


def _prefixes(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``(doc_id, node, n, map, prefix)`` for every row."""
    order = np.argsort(frequent)
    known = frequent[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, maps, prefixes = [], [], [], []
            for text in batch.column(1).to_pylist():
                values = shingles_of(text)
                n = len(values)
                nodes.append(_node(values))
                sizes.append(n)
                maps.append(_map(values))
                if n and len(known):
                    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                    rank = np.where(known[at] == values, order[at] + 1, 0)
                    values = values[np.argsort(rank, kind="stable")]
                prefixes.append(values[: n - -(-LEAST[0] * n // LEAST[1]) + 1].view(np.int64))
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, dtype=np.int64))
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32), flat)
            ids = batch.column(0).cast(pa.int64())
            columns = [ids, pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "map", "prefix"])

    return texts.mapInArrow(run, "doc_id long, node long, n int, map binary, prefix array<long>")


def _members(rows: DataFrame) -> DataFrame:
    """``(token, node, n, at, least, fits)``: the lists of prefix shingles that several sets have, and whether each set fits the least one of its list."""
    rows = rows.where("doc_id is not null").select("node", "n", "prefix")
    amount = rows.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = task_count(rows.sparkSession, amount, _PREFIX_ROWS_PER_TASK)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = np.sort(np.unique(batch.column(0).to_numpy(), return_index=True)[1])
            node, n, lists = (c.take(pa.array(once)) for c in batch.columns)
            lengths = lists.value_lengths().to_numpy().astype(np.int64)
            tokens = lists.flatten().to_numpy().view(np.uint64)
            part = (tokens % np.uint64(parts)).astype(np.int32)
            found = np.empty(len(tokens), dtype=_RECORD)
            found["token"] = tokens >> np.uint64(32)
            found["node"] = np.repeat(node.to_numpy(), lengths)
            found["n"] = np.repeat(n.to_numpy(), lengths)
            found["at"] = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            order = np.argsort(part, kind="stable")
            to, starts = np.unique(part[order], return_index=True)
            offsets = (np.r_[starts, len(tokens)] * _RECORD.itemsize).astype(np.int64)
            records = pa.Array.from_buffers(pa.large_binary(), len(to), [None, pa.py_buffer(offsets), pa.py_buffer(found[order].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), records.cast(pa.binary())], names=["part", "records"])

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        found = np.concatenate([np.frombuffer(v.as_buffer(), dtype=_RECORD) for v in rows.column("records")])
        found = found[np.lexsort((found["at"], found["node"], found["token"]))]
        token, node = found["token"], found["node"]
        new = np.r_[True, token[1:] != token[:-1]]
        found, new = (x[new | np.r_[True, node[1:] != node[:-1]]] for x in (found, new))
        starts = np.flatnonzero(new)
        lengths = np.diff(np.r_[starts, len(found)])
        least = found[np.repeat(starts, lengths)]
        shared = np.repeat(lengths > 1, lengths)
        found, least = found[shared], least[shared]
        n, at, m, other_at = (x[c].astype(np.int64) for x in (found, least) for c in ("n", "at"))
        token = found["token"].astype(np.int64) | (part << 32)
        fits = (found["node"] != least["node"]) & _may_link(n, at, m, other_at)
        columns = {"token": token, **{c: found[c] for c in ("node", "n", "at")}, "least": least["node"], "fits": fits}
        return pa.table({c: np.ascontiguousarray(v) for c, v in columns.items()})

    dealt = rows.mapInArrow(packed, "part int, records binary")
    return dealt.groupBy("part").applyInArrow(run, "token long, node long, n int, at int, least long, fits boolean")


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs (a, b)`` whose sizes and maps let them link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
            keep = LEAST[1] * np.minimum(n, m) >= LEAST[0] * np.maximum(n, m)
            most = n + m - 2 * _needed(n, m)
            for i in np.flatnonzero(keep).tolist():
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.uint64) for c in (4, 5))
                size = min(len(x), len(y))
                keep[i] = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    sides = [nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("map").alias(f"map_{c}")) for c in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(run, "a long, b long")


def _fetched(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` with one of ``ids (doc_id)`` and few others: a table of at most ``SLOTS`` words of 64 bits lets them through.

    So texts that no candidate needs are not shuffled. A full table lets every text through, and a join on the sets follows.
    """
    hashed = F.xxhash64("doc_id")
    slot, bit = hashed.bitwiseAND(F.lit(SLOTS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 58).cast("int"))
    marks = ids.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("marks"))
    # The hint is on a table of at most SLOTS rows of two numbers.
    return texts.withColumn("slot", slot).join(F.broadcast(marks), "slot").where(F.col("marks").bitwiseAND(bit) != 0).select("doc_id", "text")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs (a, b)`` whose whole sets are similar enough."""
    pairs = stage(_close(stage(pairs, "pairs"), nodes), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", F.col("first_id").alias("doc_id"))
    wanted = stage(wanted, "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles_of(text) for text in batch.column(1).to_pylist()]
            nodes, values = pa.array(map(_node, found), pa.int64()), pa.array([v.tobytes() for v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([nodes, values], names=["node", "set"])

    found = _fetched(texts, wanted.select("doc_id")).mapInArrow(sets, "node long, set binary")
    found = stage(found.join(wanted.select("node"), "node").dropDuplicates(["node"]), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(LEAST[1] * shared >= LEAST[0] * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(found.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(found.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _brief(nodes: DataFrame) -> DataFrame:
    """``(node, brief)``: the maps folded to ``BRIEF`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [_folded(np.frombuffer(v.as_buffer(), dtype=np.uint64), BRIEF // 64).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], names=["node", "brief"])

    return nodes.select("node", "map").mapInArrow(run, "node long, brief binary")


def _across(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of differently labelled sets of a list (``token, node, n, at, label``); long lists are dealt out in blocks."""
    spark = members.sparkSession
    counts = members.groupBy("token").agg(F.count("*").alias("count"), F.min("label").alias("least"), F.max("label").alias("most"))
    lists = stage(counts.where("least <> most").select("token", F.ceil(F.col("count") / MAX_LIST).cast("int").alias("parts"), F.col("count").alias("length")), "lists")
    rows, amount = lists.agg(F.sum(F.col("length") * F.col("parts")), F.sum(F.col("length") * F.col("parts") * F.least("length", F.lit(2 * MAX_LIST)))).first()
    tasks = max(task_count(spark, rows or 0, _MEMBERS_PER_TASK), task_count(spark, amount or 0, _PAIRS_PER_TASK))
    dealt = members.join(lists.drop("length"), "token").join(_brief(nodes), "node").withColumn("part", F.pmod(F.hash("node"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("token", "node", "n", "at", "label", "brief", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("token", "p", "q"), F.lit(tasks)).cast("int"))

    def run(rows: pa.Table) -> pa.Table:
        columns = [rows.column(c).to_numpy() for c in ("token", "p", "q", "n", "part", "at", "node", "label")]
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        token, p, q, n, part, at, node, label = (c[order].astype(np.int64) for c in columns)
        brief = np.frombuffer(b"".join(rows.column("brief").to_pylist()), dtype=np.uint64).reshape(len(token), -1)[order]
        edge = np.flatnonzero((token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
        ends = np.repeat(np.r_[edge, len(token)], np.diff(np.r_[0, edge, len(token)]))
        found = [np.empty((0, 2), dtype=np.int64)]
        left, right = np.arange(len(token)), np.arange(len(token))
        while len(left):  # every set with the next one of its block by size, the one after, and so on as far as sizes allow
            right = right + 1
            on = right < ends[left]
            left, right = left[on], right[on]
            on = LEAST[1] * n[left] >= LEAST[0] * n[right]
            left, right = left[on], right[on]
            # A pair of blocks has the pairs between them only; those inside have tasks of their own.
            apart = (label[left] != label[right]) & ((p[left] == q[left]) | (part[left] != part[right]))
            i, j = (x[apart & _may_link(n[left], at[left], n[right], at[right])] for x in (left, right))
            close = np.bitwise_count(brief[i] ^ brief[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j] - 2 * _needed(n[i], n[j])
            i, j = node[i[close]], node[j[close]]
            found.append(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return dealt.groupBy("task").applyInArrow(run, "a long, b long").distinct()


def _by_fingerprint(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets whose fingerprints are equal or linked; of equal fingerprints each set meets the least."""
    found = stage(simhash.fingerprints(texts.where("doc_id is not null"), "doc_id", "text", SHINGLE), "fingerprints")
    found = found.join(nodes.select("node", F.col("first_id").alias("doc_id")), "doc_id").select("node", "fp")
    found = stage(found.distinct(), "fingerprints")
    least = stage(found.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    equal = found.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = simhash.links(least.select("fp"), MAX_BITS)
    near = near.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return equal.unionByName(near.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, component_id)``: the least id that each row reaches through links."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    with scratch(spark) as result:
        with scratch(spark) as keep:
            rows = stage(_prefixes(texts, _frequent(texts)), "prefixes")
            members = keep(_members(rows), "members")
            nodes = keep(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("map").alias("map")), "nodes")
            rows = keep(rows.select("doc_id", "node"), "rows")
        with scratch(spark) as keep:
            stars = members.where("fits").select(F.col("least").alias("a"), F.col("node").alias("b"))
            links = keep(_verified(_by_fingerprint(texts, nodes).unionByName(stars).distinct(), nodes, texts), "links")
            roots = keep(connected_components(links), "roots")
        with scratch(spark) as keep:
            labelled = members.join(roots, "node", "left").select("token", "node", "n", "at", F.coalesce("root", "node").alias("label"))
            links = links.unionByName(keep(_verified(_across(labelled, nodes), nodes, texts), "links"))
            roots = keep(connected_components(links), "roots")
        known = nodes.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
        least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
        return result(rows.join(known.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id"), "near-copies")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the row of the least id of each component; rows without an id are kept as they are."""
    found = near_copies(docs.where(F.col(id_column).isNotNull()), id_column, text_column)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(gone, id_column, "left_anti").select(*docs.columns)
