"""Alignment of two tokenizers over the same bytes, and corpus-wide counts of the token pairs that it links.

Tokenizer A is a byte-level BPE (``tokenizers`` file) and reads a space and the text, tokenizer B is a ``sentencepiece`` model
and adds that space itself. Both cut the same bytes into tokens. A byte where a token of A and one of B both end is
a shared cut. The cuts are found by divide and conquer: in each interval the shared cut nearest to the middle token of A is
located by bisecting B's ends, first at the middle, then in rings of doubled width to both sides; the interval is split
there and both halves are searched in the same way. An interval without a shared cut is a leaf group. All intervals of one
depth, of all texts of a chunk, are handled together.

Tokens of a group are linked, every A with every B. ``link_counts`` gives in how many documents each pair of ids is
linked; ``align`` scores each document by those counts. Tokens are made once: blocks of documents are written to the shared
folder with their table of distinct pairs. Only those tables travel, dealt out by a hash of the pair and packed, so a pair that
every document holds counts once per block; the counts go back to the blocks in the order of their pairs. The highest
count of each A id is one number per id of A's vocabulary, and thereby small enough to be sent to all tasks.

Edge cases: null and empty texts, and texts that one tokenizer does not give back byte by byte, have no tokens, zeros and an
empty ``groups_sha256``; special tokens' strings are plain text; a very long text is a chunk of its own; repeated rows and
rows that share an id count as documents each; rows without an id are scored under a null id; an empty table gives
an empty result; other columns are never read, whatever their names. Ties for the highest count are all best.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import task_count
from emberlake.session import stage

_CHUNK_CHARS = 1_000_000
_SLICE_LINKS = 4_000_000
#: A block is closed when it has so many rows or so many pairs of its documents.
_BLOCK_ROWS = 10_000
_BLOCK_PAIRS = 6_000_000
_BUCKET_PAIRS = 2_000_000
# Fixed value: how byte-level BPE cuts a text before merging.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letter_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str) -> None:
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        letters, special = _letter_bytes(), {t["content"] for t in spec["added_tokens"]}
        # The ids of such a vocabulary follow the order of its merges, so they serve as ranks.
        ranks = {bytes(letters[c] for c in token): number for token, number in spec["model"]["vocab"].items() if token not in special}
        self._a = tiktoken.Encoding("a", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            self.bytes_a[number] = token
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [(self._b.id_to_piece(i), self._b.is_byte(i)) for i in range(self._b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in pieces]
        self.lengths_a = np.array([len(b) for b in self.bytes_a], dtype=np.int64)
        self.lengths_b = np.array([len(b) for b in self.bytes_b], dtype=np.int64)
        # Decimal ids with what may follow them: a comma inside a side, else the end of the side.
        self.names_a = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"]
        self.names_b = [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Token ids of both; none where a text is empty or its tokens do not join to its bytes."""
        as_read = [" " + t if t else "" for t in texts]
        a = [self._a.encode_ordinary(t) for t in as_read]
        b = self._b.encode([t or "" for t in texts], num_threads=1)
        for i, text in enumerate(as_read):
            raw = text.encode()
            if not raw or b"".join(map(self.bytes_a.__getitem__, a[i])) != raw or b"".join(map(self.bytes_b.__getitem__, b[i])) != raw:
                a[i], b[i] = [], []
        return a, b


@lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _nearest_cuts(lo: np.ndarray, hi: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each interval of A's tokens the one in ``lo .. hi - 1`` nearest to the middle that ends where one of B ends, or -1."""
    middle, found = (lo + hi - 1) // 2, np.full(len(lo), -1)
    open_, near, far = np.arange(len(lo)), 0, 0
    while len(open_):
        ring = np.arange(near, far + 1)
        distance = np.full((2, len(open_)), far + 1)
        for side, sign in enumerate((-1, 1)):
            at = middle[open_, None] + sign * ring
            inside = (at >= lo[open_, None]) & (at < hi[open_, None])
            wanted = ends_a[at[inside]]
            hit = np.zeros(at.shape, dtype=bool)
            hit[inside] = ends_b[np.searchsorted(ends_b, wanted)] == wanted
            distance[side] = np.where(hit.any(axis=1), near + hit.argmax(axis=1), far + 1)
        met = distance.min(axis=0) <= far
        left = distance[0] <= distance[1]
        found[open_[met]] = (middle[open_] + np.where(left, -distance[0], distance[1]))[met]
        near, far = far + 1, 2 * far + 1
        more = ~met & ((middle[open_] - near >= lo[open_]) | (middle[open_] + near < hi[open_]))
        open_ = open_[more]
    return found


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, texts_a: np.ndarray, texts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and of B end at a shared cut.

    ``ends`` are byte ends over all texts one behind the other; ``texts`` hold the first token of each text, and the number
    of tokens at last. Texts have tokens of both kinds.
    """
    cut_a, cut_b = np.zeros(len(ends_a), dtype=bool), np.zeros(len(ends_b), dtype=bool)
    cut_a[texts_a[1:] - 1], cut_b[texts_b[1:] - 1] = True, True
    lo, hi = texts_a[:-1], texts_a[1:] - 1
    while len(lo):
        wide = hi > lo
        lo, hi = lo[wide], hi[wide]
        found = _nearest_cuts(lo, hi, ends_a, ends_b)
        lo, hi, at = lo[found >= 0], hi[found >= 0], found[found >= 0]
        cut_a[at] = True
        cut_b[np.searchsorted(ends_b, ends_a[at])] = True
        lo, hi = np.concatenate([lo, at + 1]), np.concatenate([at, hi])
    return cut_a, cut_b


class Aligned:
    """The tokens of a chunk of texts in groups.

    ``group_a`` and ``group_b`` number the groups over the chunk; ``size_a`` and ``size_b`` count their tokens.
    """

    def __init__(self, tools: Tokenizers, texts: list[str | None]) -> None:
        ids_a, ids_b = tools.encode(texts)
        self.tools = tools
        self.n_a, self.n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(n.sum())) for ids, n in ((ids_a, self.n_a), (ids_b, self.n_b)))
        with_tokens = self.n_a > 0
        first_a, first_b = (np.concatenate([[0], np.cumsum(n[with_tokens])]) for n in (self.n_a, self.n_b))
        self.cut_a, self.cut_b = shared_cuts(np.cumsum(tools.lengths_a[self.a]), np.cumsum(tools.lengths_b[self.b]), first_a, first_b)
        self.group_a, self.group_b = (np.cumsum(cut) - cut for cut in (self.cut_a, self.cut_b))
        n_groups = int(self.cut_a.sum())
        self.size_a, self.size_b = (np.bincount(g, minlength=n_groups) for g in (self.group_a, self.group_b))
        self.text_of_group = np.repeat(np.arange(len(texts)), self.n_a)[self.cut_a]
        self.n_groups = np.bincount(self.text_of_group, minlength=len(texts))
        links = self.size_a * self.size_b
        self.n_links = np.bincount(self.text_of_group, weights=links, minlength=len(texts)).astype(np.int64)

    def digests(self) -> list[str]:
        """SHA-256 of every text's groups written as ``a1,a2|b1;a3|b2,b3``; the empty text where there are no tokens."""
        # A token's place among all: those of its kind before it and those of the other kind in earlier groups.
        place_a = np.arange(len(self.a)) + (np.cumsum(self.size_b) - self.size_b)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(self.size_a)[self.group_b]
        names = np.empty(len(self.a) + len(self.b), dtype=object)
        names[place_a] = np.array(self.tools.names_a, dtype=object)[2 * self.a + self.cut_a]
        names[place_b] = np.array(self.tools.names_b, dtype=object)[2 * self.b + self.cut_b]
        found, at = [], 0
        for size in (self.n_a + self.n_b).tolist():
            found.append(hashlib.sha256("".join(names[at : at + size].tolist())[:-1].encode()).hexdigest() if size else "")
            at += size
        return found

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``text * A's ids * B's ids + a * B's ids + b``, ascending, and how often each is linked."""
        width_b = len(self.tools.bytes_b)
        width = width_b * len(self.tools.bytes_a)
        start_a, start_b = (np.cumsum(s) - s for s in (self.size_a, self.size_b))
        links = self.size_a * self.size_b
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        large = np.flatnonzero(links > _SLICE_LINKS)
        for g in large.tolist():  # of a group without cuts only distinct ids meet
            ids_a, times_a = np.unique(self.a[start_a[g] : start_a[g] + self.size_a[g]], return_counts=True)
            ids_b, times_b = np.unique(self.b[start_b[g] : start_b[g] + self.size_b[g]], return_counts=True)
            parts.append(((self.text_of_group[g] * width + ids_a[:, None] * width_b + ids_b).ravel(), np.outer(times_a, times_b).ravel()))
        links[large] = 0
        slices = (np.cumsum(links) - links) // _SLICE_LINKS
        edges = np.concatenate([[0], np.flatnonzero(np.diff(slices)) + 1, [len(links)]]).tolist()
        for g, h in zip(edges[:-1], edges[1:]) if len(links) else ():
            tokens = np.arange(start_a[g], start_a[h - 1] + self.size_a[h - 1])
            tokens = tokens[links[self.group_a[tokens]] > 0]
            of = self.group_a[tokens]
            times = self.size_b[of]
            left = np.repeat(self.text_of_group[of] * width + self.a[tokens] * width_b, times)
            right = np.repeat(start_b[of] - (np.cumsum(times) - times), times) + np.arange(len(left))
            parts.append(np.unique(left + self.b[right], return_counts=True))
        if len(parts) < 2:
            return parts[0] if parts else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """Ids and whole texts, as many as hold a bounded number of characters, a longer text alone."""
    ids: list[int | None] = []
    texts: list[str | None] = []
    chars = 0
    for batch in batches:
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if ids and chars + len(text or "") > _CHUNK_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(id_)
            texts.append(text)
            chars += len(text or "")
    if ids:
        yield ids, texts


def _packed(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers of ``width`` bytes, all lowest bytes first, compressed."""
    octets = np.ascontiguousarray(numbers, dtype=f"<u{width}").view(np.uint8)
    return zstandard.compress(octets.reshape(-1, width).T.tobytes(), 1)


def _unpacked(blob: bytes, width: int = 4) -> np.ndarray:
    octets = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(octets.T).view(f"<u{width}").ravel().astype(np.int64)


def _packed_rising(numbers: np.ndarray) -> bytes:
    return _packed(np.diff(numbers, prepend=0), 8)


def _unpacked_rising(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob, 8))


def _bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


_BLOCK = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
    "sizes array<int>, slots binary, times binary, n_pairs long, pairs binary, docs binary"
)
_BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")), ("digests", pa.list_(pa.string())),
    ("sizes", pa.list_(pa.int32())), ("slots", pa.binary()), ("times", pa.binary()), ("n_pairs", pa.int64()), ("pairs", pa.binary()), ("docs", pa.binary()),
])
_SCORES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def groups(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, groups array<struct<a array<int>, b array<int>>>)``: the token ids of each group in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(path_a, path_b)
        for ids, texts in _chunks(batches):
            found = Aligned(tools, texts)
            ends = lambda sizes: np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            sides = [pa.ListArray.from_arrays(ends(s), pa.array(x.astype(np.int32))) for s, x in ((found.size_a, found.a), (found.size_b, found.b))]
            column = pa.ListArray.from_arrays(ends(found.n_groups), pa.StructArray.from_arrays(sides, names=["a", "b"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), column], names=["doc_id", "groups"])

    return _texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def blocks_of(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents in blocks: a block's table of distinct pairs with the number of its documents that hold each, and per
    document its figures and the slots of its pairs in that table."""

    def closed(number: int, rows: list[tuple], held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pairs, slots = np.unique(np.concatenate([k for k, _, _ in held]), return_inverse=True)
        times, sizes = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        row = [
            number, *zip(*rows), sizes, _packed(slots), _packed(times),
            len(pairs), _packed_rising(pairs), _packed(np.bincount(slots, minlength=len(pairs))),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK_ARROW)], schema=_BLOCK_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(path_a, path_b)
        width = len(tools.bytes_a) * len(tools.bytes_b)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for ids, texts in _chunks(batches):
            found = Aligned(tools, texts)
            keys, times = found.pairs()
            rows += zip(ids, *(x.tolist() for x in (found.n_a, found.n_b, found.n_groups, found.n_links)), found.digests())
            held.append((keys % width, times, np.bincount(keys // width, minlength=len(texts))))
            size += len(keys)
            if size >= _BLOCK_PAIRS or len(rows) >= _BLOCK_ROWS:
                yield closed(number, rows, held)
                rows, held, size, number = [], [], 0, number + 1
        if rows:
            yield closed(number, rows, held)

    return _texts(docs, id_column, text_column).mapInArrow(run, _BLOCK)


def _dealt(blocks: DataFrame) -> tuple[DataFrame, int]:
    """``(bucket, block, pairs, docs)``: the pair tables of all blocks cut by a hash of the pair; and the number of buckets."""
    total = blocks.agg(F.sum("n_pairs")).first()[0] or 0
    buckets = task_count(blocks.sparkSession, total, _BUCKET_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, docs in zip(*(c.to_pylist() for c in batch.columns)):
                pairs, docs = _unpacked_rising(pairs), _unpacked(docs)
                bucket = _bucket_of(pairs, buckets)
                order = np.argsort(bucket, kind="stable")
                used, starts = np.unique(bucket[order], return_index=True)
                parts = np.split(order, starts[1:]) if len(used) else []
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(used, pa.int64()), "block": pa.array([block] * len(used), pa.int64()),
                    "pairs": pa.array([_packed_rising(pairs[p]) for p in parts], pa.binary()), "docs": pa.array([_packed(docs[p]) for p in parts], pa.binary()),
                })

    return blocks.select("block", "pairs", "docs").mapInArrow(run, "bucket long, block long, pairs binary, docs binary"), buckets


def _counted(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The pairs of each row, all distinct pairs, and in how many documents each is."""
    each = [_unpacked_rising(b) for b in rows.column("pairs").to_pylist()]
    docs = np.concatenate([_unpacked(b) for b in rows.column("docs").to_pylist()])
    pairs, slots = np.unique(np.concatenate(each), return_inverse=True)
    return each, pairs, np.bincount(slots, weights=docs, minlength=len(pairs)).astype(np.int64)


def link_counts(blocks: DataFrame, width_b: int) -> DataFrame:
    """``(a, b, n_docs)``: in how many documents each pair of ids is linked. ``width_b`` is the size of B's vocabulary."""

    def run(rows: pa.Table) -> pa.Table:
        _, pairs, n_docs = _counted(rows)
        return pa.table({"a": pairs // width_b, "b": pairs % width_b, "n_docs": n_docs})

    return _dealt(blocks)[0].groupBy("bucket").applyInArrow(run, "a long, b long, n_docs long")


def align(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row of ``docs``."""
    tools = tokenizers(path_a, path_b)
    width_a, width_b = len(tools.bytes_a), len(tools.bytes_b)
    blocks = stage(blocks_of(docs, path_a, path_b, id_column, text_column), "aligned")
    dealt, buckets = _dealt(blocks)

    def count(rows: pa.Table) -> pa.Table:
        each, pairs, n_docs = _counted(rows)
        ids, at = np.unique(pairs // width_b, return_index=True)
        highest = np.maximum.reduceat(n_docs, at)
        counts = [_packed(n_docs[np.searchsorted(pairs, p)], 8) for p in each]
        # The last row has no block: it holds the highest count of each A id of this bucket.
        return pa.table({
            "block": pa.concat_arrays([rows.column("block").combine_chunks(), pa.array([None], pa.int64())]),
            "bucket": pa.array([rows.column("bucket")[0].as_py()] * (len(each) + 1), pa.int64()), "counts": pa.array([*counts, None], pa.binary()),
            "ids": pa.array([*[None] * len(each), ids], pa.list_(pa.int64())), "highest": pa.array([*[None] * len(each), highest], pa.list_(pa.int64())),
        })

    counted = stage(dealt.groupBy("bucket").applyInArrow(count, "block long, bucket long, counts binary, ids array<long>, highest array<long>"), "link-counts")
    tops = counted.where("block is null").select(F.explode(F.arrays_zip("ids", "highest")).alias("x")).groupBy("x.ids").agg(F.max("x.highest").alias("n")).collect()
    top_of = np.zeros(width_a, dtype=np.int64)
    for row in tops:  # at most one per id of A
        top_of[row["ids"]] = row["n"]
    tops = docs.sparkSession.sparkContext.broadcast(top_of)
    answers = counted.where("block is not null").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                pairs, sizes = _unpacked_rising(row["pairs"]), np.array(row["sizes"], dtype=np.int64)
                n_docs = np.zeros(len(pairs), dtype=np.int64)
                if len(pairs):
                    order = np.argsort(_bucket_of(pairs, buckets), kind="stable")
                    n_docs[order] = np.concatenate([_unpacked(x["counts"], 8) for x in row["answers"]])
                slots, times = _unpacked(row["slots"]), _unpacked(row["times"])
                best = times * (n_docs == tops.value[pairs // width_b])[slots]
                ends = np.cumsum(sizes)
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0) for x in (best, times * n_docs[slots])]
                columns = [*(row[n] for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")), *sums]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(row["digests"], pa.string())], names=[c.split()[0] for c in _SCORES.split(", ")])

    # Blocks whose documents have no tokens have no answers.
    return blocks.drop("docs", "n_pairs").join(answers, "block", "left").mapInArrow(run, _SCORES)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_paths())
