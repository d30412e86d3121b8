"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding look-alike letters and digits.

``fold`` lower-cases, turns look-alike letters of other scripts into Latin ones and digits inside words
into the letters that they stand for. Lexicon entries are whole words or word beginnings with a weight (log odds),
learned from a bounded sample of labelled rows; exception phrases are two-word phrases with an entry
that occur in harmless rows, and take the entry's weight back. The weights found in a text are summed, and
the sum and its share of the text's length go through a logistic function fitted on the same sample.

Edge cases: null and empty texts count as texts without hits; rows without an id or a label are not learned from; a
label that says both 0 and 1 counts as 1; without any labelled row of both kinds the lexicon is empty and all scores are 0;
repeated rows get equal scores; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.session import stage

THRESHOLD = 0.3
_LENGTHS = (4, 5, 6, 7)
_LEAST_ROWS = 8

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
# Digits and signs that stand for letters.
_STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_HAS_LOOK_ALIKE = re.compile("[Ͱ-ԯ！-～​-‍­]")
_HIDDEN = re.compile("[​-‍­]")
_MIXED = re.compile(r"(?<![\w@$])(?=[a-z0134578@$!]*[a-z])[a-z]*(?:[0134578@$]|![a-z])[a-z0134578@$!]*[a-z0134578]")
_DIGIT = re.compile(r"[0-9@$]|![a-z]")
_TO_LATIN, _TO_LETTER = str.maketrans(_LOOK_ALIKES), str.maketrans(_STAND_INS)
_WORD = re.compile(r"[^\W\d_]{3,40}")


def fold(text: str | None) -> str:
    """A text in the form in which it is matched: words apart by one space, look-alikes and stand-ins resolved."""
    out = (text or "").lower()
    if _HAS_LOOK_ALIKE.search(out):
        out = _HIDDEN.sub("", unicodedata.normalize("NFKC", out)).lower().translate(_TO_LATIN)
    if _DIGIT.search(out):
        out = _MIXED.sub(lambda m: m[0].translate(_TO_LETTER), out)
    return " ".join(out.split())


@dataclass
class Model:
    """``words`` and ``beginnings`` with weights; ``exceptions``: phrases that clear the entry inside; the logistic part."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def matcher(self):
        automaton = ahocorasick.Automaton()
        entries: dict[str, tuple[float, float, bool]] = {}
        for word, weight in self.words.items():
            entries[word] = (weight, 0.0, False)
        for begin, weight in self.beginnings.items():
            entries[begin] = (entries.get(begin, (0.0,))[0], weight, False)
        for phrase in self.exceptions:
            entries[phrase] = (0.0, 0.0, True)
        for key, value in entries.items():
            automaton.add_word(key, (len(key), *value))
        automaton.make_automaton()
        return automaton if entries else None


def hits(folded: str, automaton) -> list[tuple[int, int, float]]:
    """``(start, end, weight)`` of the entries in a folded text: the heaviest of each word, less the exceptions."""
    best: dict[int, tuple[int, float]] = {}
    cleared: list[tuple[int, int]] = []
    if automaton is not None:
        for last, (size, as_word, as_begin, is_exception) in automaton.iter(folded):
            start, end = last - size + 1, last + 1
            if start and folded[start - 1].isalnum():
                continue
            closed = end == len(folded) or not folded[end].isalnum()
            if is_exception:
                if closed:
                    cleared.append((start, end))
                continue
            weight = max(as_word if closed else 0.0, as_begin)
            if weight > best.get(start, (0, 0.0))[1]:
                best[start] = (end, weight)
    return [(s, e, w) for s, (e, w) in sorted(best.items()) if not any(a <= s and e <= b for a, b in cleared)]


def _features(folded: str, automaton) -> tuple[float, float]:
    total = sum(w for _, _, w in hits(folded, automaton))
    return math.log1p(total), math.log1p(100.0 * total / (folded.count(" ") + 10))


def _score(model: Model, features: tuple[float, float]) -> float:
    z = model.coefficients[0] + model.coefficients[1] * features[0] + model.coefficients[2] * features[1]
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _candidates(folded: str) -> set[str]:
    """Whole words, marked by a final ``$``, and their beginnings."""
    words = set(_WORD.findall(folded))
    return {w + "$" for w in words} | {w[:n] for w in words for n in _LENGTHS if len(w) > n}


def _counts(rows: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """In how many rows each candidate occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                own = _candidates(fold(text))
                found.update(own if among is None else own & among)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["entry", "n"])

    return rows.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, max_entries: int) -> dict[str, float]:
    """Entries that occur far more often in toxic rows, without those that a better one makes superfluous."""
    base = n_toxic / (n_toxic + n_clean)
    weights: dict[str, float] = {}
    for entry, t in toxic.items():
        n = clean.get(entry, 0)
        odds = math.log((t + 0.5) / (n_toxic + 1) / ((n + 0.5) / (n_clean + 1)))
        z = (t - (t + n) * base) / math.sqrt((t + n) * base * (1 - base))
        if odds >= 1.5 and z >= 6:
            weights[entry] = odds
    longer: dict[str, int] = {}
    for entry in weights:
        bare = entry.rstrip("$")
        for size in _LENGTHS:
            if len(bare) > size or (len(bare) == size and entry.endswith("$")):
                share = 0.95 if not entry.endswith("$") else 0.8
                longer[bare[:size]] = max(longer.get(bare[:size], 0), int(toxic[entry] / share))
    kept = {e: w for e, w in weights.items() if e.endswith("$") or longer.get(e, 0) < toxic[e]}
    begins = {e for e in kept if not e.endswith("$")}
    purity = lambda e: toxic[e] / (toxic[e] + clean.get(e, 0))
    covered = lambda e: any(e[:n] in begins and e[:n] != e and purity(e[:n]) >= purity(e) - 0.05 for n in _LENGTHS if len(e) > n)
    kept = {e: w for e, w in kept.items() if not covered(e)}
    return dict(sorted(kept.items(), key=lambda x: (-x[1] * toxic[x[0]], x[0]))[:max_entries])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps with a slight ridge."""
    design, beta = np.c_[np.ones(len(x)), x], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 0.05 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(3)
        beta += np.linalg.solve(hessian, gradient)
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_training_rows: int = 30_000, max_candidates: int = 20_000, max_entries: int = 2_000) -> Model:
    """Learn a model from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``.

    At most ``max_training_rows`` labelled rows are used: those first by a hash of their id. ``usable`` restricts
    them by a condition on ``doc_id``. Equal texts are one row, toxic if any of them is. Of the entries of toxic training rows the
    ``max_candidates`` most frequent are weighed; lexicon and exceptions hold up to ``max_entries`` each, the heaviest and most
    frequent first.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known if usable is None else known.where(usable)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training_rows)
    # The hint is on at most max_training_rows rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    rows = stage(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text"), "training")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model()
    toxic_counts = _counts(rows.where("toxic = 1"), None).where(F.col("n") >= _LEAST_ROWS).orderBy(F.desc("n"), "entry").limit(max_candidates)
    toxic = {r["entry"]: r["n"] for r in toxic_counts.collect()}
    clean = {r["entry"]: r["n"] for r in _counts(rows.where("toxic = 0"), frozenset(toxic)).collect()}
    weights = _choose(toxic, clean, sizes[1], sizes[0], max_entries)
    model = Model({e[:-1]: w for e, w in weights.items() if e.endswith("$")}, {e: w for e, w in weights.items() if not e.endswith("$")})
    model.exceptions = _exceptions(rows, model, max_entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.matcher()
        for batch in batches:
            pairs = [_features(fold(t), automaton) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], names=["toxic", "a", "b"])

    found = rows.select("toxic", "text").mapInArrow(run, "toxic int, a double, b double").groupBy("toxic", "a", "b").count().toPandas()
    found = found.loc[found.index.repeat(found["count"])].sort_values(["toxic", "a", "b"])
    model.coefficients = _logistic(found[["a", "b"]].to_numpy(), found["toxic"].to_numpy(dtype=float))
    return model


def _exceptions(rows: DataFrame, model: Model, most: int) -> list[str]:
    """Two-word phrases around an entry that are found in harmless rows only, in three or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.matcher()
        for batch in batches:
            found: Counter[tuple[str, int]] = Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded, own = fold(text), set()
                for start, end, _ in hits(folded, automaton):
                    while end < len(folded) and folded[end].isalnum():
                        end += 1
                    before, after = folded[:start].split(" ")[-2:-1] if start else [], folded[end : end + 40].split(" ")[1:2]
                    own |= {f"{w} {folded[start:end]}" for w in before if w.isalpha()} | {f"{folded[start:end]} {w}" for w in after if w.isalpha()}
                found.update((p, toxic) for p in own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.string()), pa.array([t for _, t in found], pa.int32()), pa.array(list(found.values()), pa.int64())],
                names=["phrase", "toxic", "n"],
            )

    counts = rows.select("toxic", "text").mapInArrow(run, "phrase string, toxic int, n long").groupBy("phrase")
    counts = counts.agg(F.sum(F.expr("if(toxic = 0, n, 0)")).alias("clean"), F.sum(F.expr("if(toxic = 1, n, 0)")).alias("bad"))
    return [r["phrase"] for r in counts.where("clean >= 3 and bad = 0").orderBy(F.desc("clean"), "phrase").limit(most).collect()]


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row; one pass over the texts, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.matcher()
        for batch in batches:
            scores = [_score(model, _features(fold(t), automaton)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str = "doc_id", folds: int = 4, fold_number: int = 2) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold_number


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    columns = docs.columns
    where = columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.matcher()
        for batch in batches:
            stays = [_score(model, _features(fold(t), automaton)) < threshold for t in batch.column(where).to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels, ~held_out())
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
