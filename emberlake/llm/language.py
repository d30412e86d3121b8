"""Language identification in two steps: the family first, then the language within it.

Texts become hashed counts of letter groups (one to three letters, words padded by spaces). A linear
support vector machine per family separates it from the others; inside a family one machine for every pair of
languages votes. The machines are trained by dual coordinate descent on a bounded sample of labelled rows, spread
evenly over the languages; every other row is scored in one pass without a shuffle.

Edge cases: null, empty and letterless texts are ``und`` with score 0; rows without a language are not
learned from; with one known language all texts with letters get it, with none all are ``und``; a language
without an entry among the families is a family of its own; repeated rows get equal results; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SIZE = 1 << 14
_BLOCK = 1 << 20  # letters counted at once

# Languages of each family, by ISO 639-1 code.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro", "sc"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd", "gv"],
    "indo-aryan": ["as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "uralic": ["et", "fi", "hu", "se"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"],
    "semitic": ["am", "ar", "he", "mt"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "austronesian": ["id", "jv", "mg", "mi", "ms", "tl"],
}


def family_of(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), f"own:{language}")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each character of all planes: itself if it is a letter, else a space."""
    return np.array([ord(c) if (c := chr(i)).isalpha() else 32 for i in range(0x110000)], dtype=np.uint32)


def features(text: str | None) -> np.ndarray | None:
    """The unit vector of the roots of hashed counts, with a constant last entry; None without letters."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table, counts, some = _letters(), np.zeros(_SIZE, dtype=np.int64), False
    for at in range(0, len(codes), _BLOCK):
        part = codes[at : at + _BLOCK + 2]
        part = table[part]
        filled = part != 32
        some = some or bool(filled.any())
        last = len(part) - 2 if at + _BLOCK < len(codes) else len(part)
        one = part * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
        three = (two[:-1] ^ np.uint32(0x1B873593)) * np.uint32(0xC2B2AE35) + one[2:]
        keep = filled.copy()
        keep[1:] |= filled[:-1]
        for hashes, used in ((one[:last], filled[:last]), (two[:last], (keep[1:])[:last]), (three[:last], (filled[1:-1])[:last])):
            mixed = (hashes ^ (hashes >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount((mixed >> np.uint32(18))[used], minlength=_SIZE)
    if not some:
        return None
    roots = np.sqrt(counts, dtype=np.float32)
    return np.append(roots / np.linalg.norm(roots), np.float32(1.0)).astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """A linear support vector machine (squared hinge) by dual coordinate descent; classes weigh the same."""
    weights, alpha = np.zeros(x.shape[1], dtype=np.float32), np.zeros(len(x))
    norms = (x * x).sum(axis=1)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    slack = share / (cost * 1.0)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = (y[i] * float(weights @ x[i]) - 1 + slack[i] * alpha[i]) / (norms[i] + slack[i])
            new = max(0.0, alpha[i] - step)
            weights += np.float32((new - alpha[i]) * y[i]) * x[i]
            alpha[i] = new
    return weights


@dataclass
class Model:
    """``families``: name with languages; the machines as rows of ``weights``, first one per family, then one per pair."""

    families: list[tuple[str, list[str]]] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, _SIZE + 1), dtype=np.float32))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if self.families else None
        if x is None:
            return "und", 0.0
        margins = self.weights @ x
        n = len(self.families)
        best = int(np.argmax(margins[:n])) if n > 1 else 0
        languages = self.families[best][1]
        sure = 1 / (1 + math.exp(-2 * float(margins[best]))) if n > 1 else 1.0
        votes = dict.fromkeys(languages, (0, 0.0))
        for (a, b), m in zip(self.pairs, margins[n:].tolist()):
            if a in votes and b in votes:
                for language, margin in ((a, m), (b, -m)):
                    votes[language] = (votes[language][0] + (margin > 0), votes[language][1] + margin)
        chosen = max(languages, key=lambda x: (votes[x], x))
        if len(languages) > 1:
            sure *= 1 / (1 + math.exp(-2 * votes[chosen][1] / (len(languages) - 1)))
        return chosen, sure


def learn(docs: DataFrame, usable: Column | None = None, max_training_rows: int = 1_500) -> Model:
    """Learn from ``docs (doc_id, text, lang)``: of each language equally many rows, those first by a hash of their text.

    ``max_training_rows`` bounds the sample as a whole; ``usable`` restricts the rows by a condition on ``doc_id``.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    known = known if usable is None else known.where(usable)
    keys = known.select("lang", F.xxhash64("text").alias("h")).groupBy("lang", "h").agg(F.lit(1).alias("one"))
    n_languages = max(1, known.select("lang").distinct().count())
    each = max(2, max_training_rows // n_languages)
    chosen = keys.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each).select("lang", "h")
    # The hint is on at most max_training_rows pairs.
    rows = known.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [features(t) for t in batch.column(2).to_pylist()]
            packed = [v.astype(np.float16).tobytes() if v is not None else None for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["lang", "h", "x"])

    found = rows.mapInArrow(run, "lang string, h long, x binary").where("x is not null").dropDuplicates(["lang", "h"]).toPandas()
    if found.empty:
        return Model()
    found = found.sort_values(["lang", "h"])
    x = np.frombuffer(b"".join(found["x"]), dtype=np.float16).reshape(len(found), -1).astype(np.float32)
    lang = found["lang"].to_numpy(dtype=object)
    names: dict[str, list[str]] = {}
    for language in sorted(set(lang)):
        names.setdefault(family_of(language), []).append(language)
    families = sorted(names.items())
    family = np.array([family_of(v) for v in lang], dtype=object)
    machines = [_train(x, np.where(family == name, 1.0, -1.0)) if len(families) > 1 else np.zeros(x.shape[1], np.float32) for name, _ in families]
    pairs = [pair for _, languages in families for pair in combinations(languages, 2)]
    for a, b in pairs:
        own = (lang == a) | (lang == b)
        machines.append(_train(x[own], np.where(lang[own] == a, 1.0, -1.0)))
    return Model(families, pairs, np.array(machines, dtype=np.float32))


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = learn(docs, ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
