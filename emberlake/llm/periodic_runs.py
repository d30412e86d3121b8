"""Runs of repeating words inside a text, found by multi-scale minimizers, and texts with the repetitions taken out.

A run is a stretch of words with smallest period ``q`` and a length of at least ``max(SHORTEST, REPEATS * q)`` that
neither neighbour extends. At scale ``k`` (a power of two) every place has the hash of its ``k`` words, and the places whose hash is
least in some window of ``k / 2`` neighbouring places are minimizers. A run of a period in ``(k/2, k]`` holds each window again one
period later, so its minimizers repeat at the period's distance; and since ``k`` words of it fix the phase, no equal ones lie
between. Neighbours in the list of equal minimizers, at such a distance, are therefore seeds; each is extended on the words
themselves to both sides. Periods up to ``SHORT`` are found by comparing all words with those one lag on.

Texts are laid one behind the other with a word of its own between them, so that all scales of a chunk are array operations.
Hashes only propose seeds: runs are checked on the words (a run could be missed only if two different stretches of one
period had equal 64-bit hashes).

Edge cases: null, empty and word-less texts have no runs and collapse to the empty text; a very long text is a chunk of its own;
repeated rows are searched each; an empty table gives an empty result; rows without an id are treated like all others;
other columns pass through, except that given names of outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from emberlake.llm.common import words_of

SHORTEST = 6
REPEATS = 4
SHORT = 8
_CHUNK_WORDS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MIX
    return values ^ (values >> np.uint64(29))


def _slid(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every window of ``width`` (a power of two) values."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def _same_until(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """The first place from ``at`` on, going by ``step`` (1 or -1), whose word differs from the one ``lag`` later."""
    size = max(64, 2 * lag)
    while True:
        if step > 0:
            stop = min(at + size, len(words) - lag)
            differs = np.flatnonzero(words[at:stop] != words[at + lag : stop + lag])
            if len(differs):
                return at + int(differs[0])
            if stop == len(words) - lag:
                return stop
            at = stop
        else:
            start = max(at - size + 1, 0)
            differs = np.flatnonzero(words[start : at + 1] != words[start + lag : at + 1 + lag])
            if len(differs):
                return start + int(differs[-1])
            if start == 0:
                return -1
            at = start - 1
        size *= 2


def _smallest(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of at least four periods from ``start`` has no smaller period; such a one would divide it."""
    rest, prime = period, 2
    while rest > 1:
        if rest % prime == 0:
            lag = period // prime
            if np.array_equal(words[start : start + period], words[start + lag : start + lag + period]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime = prime + 1 if prime * prime <= rest else rest
    return True


def find_runs(words: np.ndarray, longest: int) -> np.ndarray:
    """``(start, length, period)`` of all runs among numbered words, sorted by start, then period.

    ``longest`` is the number of words of the longest text in ``words``.
    """
    found: list[tuple[int, int, int]] = []
    for lag in range(1, min(SHORT, longest // REPEATS) + 1):
        breaks = np.flatnonzero(words[:-lag] != words[lag:])
        breaks = np.concatenate([[-1], breaks, [len(words) - lag]])
        length = np.diff(breaks) - 1 + lag
        for i in np.flatnonzero(length >= max(SHORTEST, REPEATS * lag)).tolist():
            start = int(breaks[i]) + 1
            if _smallest(words, start, lag):
                found.append((start, int(length[i]), lag))
    hashes, k = _mixed(words.astype(np.uint64) + np.uint64(1)), 1
    while REPEATS * (k + 1) <= longest:
        hashes, k = _mixed(hashes[:-k] * np.uint64(3) + _mixed(hashes[k:] ^ _MIX)), 2 * k
        window = k // 2
        if k <= SHORT:
            continue
        least = _slid(hashes, window, np.minimum)
        # A place is a minimizer if the largest of the minima of the windows around it is its own hash.
        edge = np.zeros(window - 1, dtype=np.uint64)
        places = np.flatnonzero(_slid(np.concatenate([edge, least, edge]), window, np.maximum) == hashes)
        places = places[np.argsort(hashes[places], kind="stable")]
        distance = np.diff(places)
        seeds = np.flatnonzero((hashes[places[1:]] == hashes[places[:-1]]) & (distance > window) & (distance <= k))
        seeds = seeds[np.lexsort((places[seeds], distance[seeds]))]
        last = (0, -1)  # the period and the end of the stretch looked at last
        for at, period in zip(places[seeds].tolist(), distance[seeds].tolist()):
            if period == last[0] and at < last[1] or words[at] != words[at + period]:
                continue
            start = _same_until(words, at, period, -1) + 1
            end = _same_until(words, at, period, 1) + period
            last = (period, end - period)
            if end - start >= REPEATS * period and _smallest(words, start, period):
                found.append((start, end - start, period))
    return np.array(sorted(set(found), key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)


def _dropped(runs: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` words some run contains after its first period."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def _searched(texts: list[list[bytes]]) -> tuple[list[list[dict[str, int]]], list[str]]:
    """Runs and collapsed texts of texts in words."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    number = numbers.setdefault
    flat = np.fromiter((number(w, len(numbers)) for w in chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
    # A number of its own stands behind each text.
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    words = np.empty(len(flat) + len(texts), dtype=np.int64)
    behind = starts + sizes
    own = np.ones(len(words), dtype=bool)
    own[behind] = False
    words[own], words[behind] = flat, len(numbers) + np.arange(len(texts))
    runs = find_runs(words, int(sizes.max(initial=0)))
    of = np.searchsorted(starts, runs[:, 0], side="right") - 1
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    each, collapsed = [], []
    for i, text in enumerate(texts):
        own_runs = runs[bounds[i] : bounds[i + 1]] - [starts[i], 0, 0]
        if len(own_runs):
            gone = _dropped(own_runs, len(text))
            text = [w for w, g in zip(text, gone.tolist()) if not g]
        each.append([{"start": s, "length": n, "period": q} for s, n, q in own_runs.tolist()])
        collapsed.append(b" ".join(text).decode("utf-8", "surrogatepass"))
    return each, collapsed


_RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
_RUN_ARROW = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def runs_and_rest(docs: DataFrame, text_column: str = "text", runs_column: str = "runs", rest_column: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of each text, by start and period, and the text whose runs are cut to their first period."""
    others = [c for c in docs.columns if c not in (runs_column, rest_column)]
    fields = [f for f in docs.schema.fields if f.name in others]
    at = others.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def coded(batch: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs, rest = _searched(texts)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, _RUN_ARROW), pa.array(rest, pa.string())], names=[*others, runs_column, rest_column])

        for batch in batches:
            held: list[list[bytes]] = []
            words, start = 0, 0
            for i, text in enumerate(batch.column(at)):
                text = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if held and words + len(text) > _CHUNK_WORDS:
                    yield coded(batch.slice(start, len(held)), held)
                    held, words, start = [], 0, i
                held.append(text)
                words += len(text)
            if held:
                yield coded(batch.slice(start, len(held)), held)

    schema = StructType([*fields, StructField(runs_column, ArrayType(_RUN)), StructField(rest_column, StringType())])
    return docs.select(*others).mapInArrow(run, schema)


def _planted(doc_id: Column, text: Column) -> Column:
    """The query's texts: of each tenth document the words from a place on repeat the first of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    return F.struct((h % 10 == 0).alias("chosen"), g.alias("g"), words_of(text).alias("words"))


def op13_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.withColumn("p", _planted(F.col("doc_id"), F.col("text"))).select("doc_id", "text", "p.chosen", "p.g", F.when(F.col("p.chosen"), F.col("p.words")).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("period", F.expr("1 + (n - a) div (3 + g % 8)"))
    word = lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("period")).cast("int"))
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    rows = rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
    found = runs_and_rest(rows).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", best)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    period = -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("best.length") / period).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
