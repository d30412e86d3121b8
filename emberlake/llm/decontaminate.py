"""Benchmark decontamination: BM25 over test items with block-max WAND, then verified overlap.

The test items form an inverted index: per word the items in order with their BM25 impacts, divided by the least score that
a passage with enough of the item can have, in blocks of neighbouring items with their largest impact. Every passage of every document is a query: windows
of twice the longest item's words, half overlapping, so that each copy of an item lies whole in one of them. Block-max
WAND, taken a block at a time, returns all items from the score ``RETRIEVE`` on. A hit counts if ``OVERLAP`` of the item's question and of its answer,
in five-word shingles, stand in the passage. The question is the text up to the last question mark, or all
but the last sentence; the answer is the rest; an item of one sentence is both.

All windows of a text are bounded at once, by the sum of their words' largest impacts and then by that sum in each block;
only blocks that reach the threshold are read. The bounds never drop a hit.

The index of the items goes to the tasks. Items are dealt into shards of at most ``SHARD_CHARACTERS`` characters, so it has
a fixed size; more shards mean further passes over the documents. Word statistics are those of all items.

Edge cases: null and empty documents have no passages; null or wordless items match nothing; items of equal text are all
reported; repeated documents are all found; with no items nothing is found; other columns are kept by the filter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In units of the least score that an item can have in a passage that passes the verification.
RETRIEVE = 1.0
OVERLAP = 0.8
SHINGLE = 5
SHARD_CHARACTERS = 8_000_000
_BLOCK = 8
_WINDOWS = 256  # bounded together
_K1, _B = 1.2, 0.75
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _shingles(tokens: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    size = min(size, len(tokens))
    return {tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)} if size else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    at = text.rfind("?") + 1
    question, answer = words(text[:at]), words(text[at:])
    if not question or not answer:
        sentences = [s for s in re.split(r"(?<=[.!?。])\s+|\n", text) if words(s)]
        question, answer = words(" ".join(sentences[:-1])), words(sentences[-1] if sentences else "")
    return (question or answer), (answer or question)


class Index:
    """Posting lists of one shard of items."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, mean_length: float, document_frequency: dict[str, int]) -> None:
        # Items with the same frequent words side by side, so that the blocks' bounds are tight.
        usual = lambda item: sorted(set(words(item[1])), key=lambda w: (-document_frequency[w], w))[:3]
        self.items, self.vocabulary = sorted(items, key=usual), {}
        self.parts = [tuple(_shingles(p) for p in question_and_answer(t)) for _, t in self.items]
        bags = [Counter(words(t)) for _, t in self.items]
        self.longest = max([sum(b.values()) for b in bags], default=0)
        idf = {w: math.log(1 + (n_items - n + 0.5) / (n + 0.5)) for w, n in document_frequency.items()}
        lists: list[list[tuple[int, float]]] = []
        for number, bag in enumerate(bags):
            length = sum(bag.values())
            impacts = {w: idf[w] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * length / mean_length)) for w, tf in bag.items()}
            # A passage may lack as many words as shingles; the rest scores this much at least.
            lacking = sum(int((1 - OVERLAP) * len(part) + 1e-9) for part in self.parts[number])
            least = sum(sorted(impacts.values())[: max(1, len(impacts) - lacking)])
            for word, impact in impacts.items():
                term = self.vocabulary.setdefault(word, len(lists))
                if term == len(lists):
                    lists.append([])
                lists[term].append((number, impact / least))
        # Per word the postings by block: which blocks it is in, its largest impact there, and the impacts themselves.
        blocks, block_most, self.postings = [], [], []
        for postings in lists:
            inside: dict[int, list[tuple[int, float]]] = {}
            for number, impact in postings:
                inside.setdefault(number // _BLOCK, []).append((number, impact))
            self.postings.append(inside)
            blocks.append(list(inside))
            block_most.append([max(i for _, i in x) for x in inside.values()])
        # The same end to end, with where each word begins.
        self.offset = np.cumsum([0, *map(len, blocks)])
        self.block = np.array([b for x in blocks for b in x], dtype=np.int64)
        self.block_most = np.array([m for x in block_most for m in x])
        self.most = np.array([*map(max, block_most), 0.0])  # the last stands for unknown words

    def bounds(self, windows: np.ndarray, terms: np.ndarray, n_windows: int) -> np.ndarray:
        """For each window and block the sum of the largest impacts of the window's ``terms`` in the block."""
        n_blocks = -(-len(self.items) // _BLOCK)
        begin = self.offset[terms]
        size = self.offset[terms + 1] - begin
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(windows, size) * n_blocks + self.block[at]
        return np.bincount(cell, weights=self.block_most[at], minlength=n_windows * n_blocks).reshape(n_windows, n_blocks)

    def retrieve(self, terms: list[int], blocks: list[int] | None = None) -> list[tuple[int, float]]:
        """All items that reach ``RETRIEVE`` with the distinct ``terms``.

        Only ``blocks`` whose bound reaches the threshold are read. There the words come in order of their impact, and no
        item is taken up once those to come could not lift it over the threshold.
        """
        if blocks is None:
            bound = self.bounds(np.zeros(len(terms), dtype=np.int64), np.asarray(terms, dtype=np.int64), 1)[0]
            blocks = np.flatnonzero(bound >= RETRIEVE - 1e-9).tolist()
        found: list[tuple[int, float]] = []
        for block in blocks:
            scores: dict[int, float] = {}
            inside = sorted(((max(i for _, i in self.postings[t][block]), t) for t in terms if block in self.postings[t]), reverse=True)
            rest = sum(most for most, _ in inside)
            for most, term in inside:
                for number, impact in self.postings[term][block]:
                    if number in scores or rest >= RETRIEVE - 1e-9:
                        scores[number] = scores.get(number, 0.0) + impact
                rest -= most
                if rest < RETRIEVE and not any(s + rest >= RETRIEVE - 1e-9 for s in scores.values()):
                    break
            found += [(n, s) for n, s in sorted(scores.items()) if s >= RETRIEVE - 1e-9]
        return found

    def hits(self, text: str | None) -> list[tuple[int, int, float, float, float]]:
        """``(item_id, first word, score, question overlap, answer overlap)``: the best passage for each item found."""
        tokens, reach, n_terms = words(text), self.longest, len(self.vocabulary)
        get = self.vocabulary.get
        ids = np.array([get(w, n_terms) for w in tokens], dtype=np.int64)
        best: dict[int, tuple[int, int, float, float, float]] = {}
        if not reach or not len(ids):
            return []
        n_windows = max(1, -(-(len(ids) - reach) // reach))
        for first in range(0, n_windows, _WINDOWS):
            many = min(_WINDOWS, n_windows - first)
            # Window w starts at word w * reach and is twice as long: each word is in its own window and the one before.
            own = ids[first * reach : (first + many + 1) * reach]
            known = np.flatnonzero(own < n_terms)
            window = np.concatenate([known // reach, known // reach - 1])
            keys = (window * n_terms + np.concatenate([own[known]] * 2))[(window >= 0) & (window < many)]
            windows, terms = np.divmod(np.unique(keys), n_terms)
            enough = np.bincount(windows, weights=self.most[terms], minlength=many) >= RETRIEVE - 1e-9
            windows, terms = windows[enough[windows]], terms[enough[windows]]
            near = self.bounds(windows, terms, many) >= RETRIEVE - 1e-9
            for w in np.flatnonzero(near.any(axis=1)).tolist():
                start = (first + w) * reach
                passage = None
                lo, hi = np.searchsorted(windows, [w, w + 1])
                for number, score in self.retrieve(terms[lo:hi].tolist(), np.flatnonzero(near[w]).tolist()):
                    passage = passage or {n: _shingles(tokens[start : start + 2 * reach], n) for n in range(1, SHINGLE + 1)}
                    overlaps = []
                    for part in self.parts[number]:
                        size = len(next(iter(part), ()))
                        overlaps.append(len(part & passage[size]) / len(part) if size else 0.0)
                    item_id = self.items[number][0]
                    if min(overlaps) >= OVERLAP and (number not in best or score > best[number][2]):
                        best[number] = (item_id, start, score, *overlaps)
        return list(best.values())


def indexes(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[Index]:
    """One index per shard of the items; a shard has a bounded number of characters."""
    known = items.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text"))
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1))
    size = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.count("*").alias("n")).first()
    n_words = known.agg(F.coalesce(F.sum(F.size(tokens)), F.lit(0))).first()[0]
    shards = max(1, -(-size["characters"] // SHARD_CHARACTERS))
    frequencies = known.select(F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    for shard in range(shards):
        own = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        rows = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect() if words(r["text"])]
        if rows:
            mine = {w for _, t in rows for w in words(t)}
            needed = items.sparkSession.createDataFrame([(w,) for w in sorted(mine)], "word string")
            counts = {r["word"]: r["n"] for r in frequencies.join(needed, "word").collect()}
            yield Index(rows, size["n"], max(1.0, n_words / size["n"]), {w: counts.get(w, 1) for w in mine})


def find(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, item_id, first_word, score, question_overlap, answer_overlap)`` for every document and item found in it."""
    schema = "doc_id long, item_id long, first_word int, score double, question_overlap double, answer_overlap double"
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    names = ["doc_id", "item_id", "first_word", "score", "question_overlap", "answer_overlap"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
    result = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *h) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for h in index.hits(t)]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        result = result.unionByName(source.mapInArrow(run, schema))
    return result


def drop_contaminated(docs: DataFrame, items: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without the documents in which an item is found; nothing is shuffled."""
    where = docs.columns.index(text_column)
    for index in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.hits(t) for t in batch.column(where).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find(docs, items)
