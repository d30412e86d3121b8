"""Personal data: detected entities receive keyed surrogates of the same type and form.

``detect`` finds mentions (e-mail and IP addresses, phone, card, account and security numbers, secrets, names of
persons) and their canonical form, so that differently written mentions of one entity share a surrogate. A surrogate is
drawn from a keyed digest of type, canonical form and attempt: letters become letters of the same script, digits
digits, check digits are made right, given names keep their gender. Names are replaced word by word, so a surname
alone still refers to the full name's surname.

Distinctness is checked over the whole collection: of entities that drew the same surrogate one keeps it, and a
surrogate that is an entity itself is given up; the others draw again until nobody is left. After ``_STRICT`` attempts
the form may grow longer, so that the draws always end.

Edge cases: null texts stay null, empty ones empty; rows without an id are treated like others; repeated rows get equal
results; an empty table gives an empty result; all columns of the input are kept, an input column named ``n_replaced`` is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from emberlake.session import stage

_STRICT = 8

# Titles by gender, given names by gender, consonants and vowels by script.
_TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин"],
    "n": ["Dr", "Prof", "Mx"],
}
_GIVEN = {
    "f": ["Alice", "Anna", "Barbara", "Claire", "Elena", "Emily", "Emma", "Ingrid", "Isabel", "Jane", "Julia", "Laura", "Linda", "Maria", "Marie", "Mary", "Olga", "Patricia", "Sarah", "Sophie", "Susan", "Ursula", "Анна", "Елена", "Мария", "Ольга", "Μαρία", "Ελένη"],
    "m": ["Alexander", "Carlos", "Charles", "David", "Hans", "Ivan", "James", "John", "Jorge", "José", "Karl", "Luis", "Michael", "Paul", "Peter", "Pierre", "Richard", "Robert", "Thomas", "William", "Александр", "Иван", "Пётр", "Сергей", "Γιώργος", "Νίκος"],
}
_SOUNDS = {
    "latin": ("bcdfghjklmnprstvw", "aeiou", {"f": ["a", "ia", "ine"], "m": ["o", "us", "er"]}),
    "cyrillic": ("бвгджзклмнпрстх", "аеиоу", {"f": ["а", "ия"], "m": ["ор", "ен"]}),
    "greek": ("βγδζκλμνπρστφχ", "αειου", {"f": ["α", "η"], "m": ["ος", "ης"]}),
}

_GENDER_OF = {w: g for g, words in (*_TITLES.items(), *_GIVEN.items()) for w in words}
_CAPITAL = r"[^\W\d_a-zà-öø-ÿа-яёα-ωά-ώ][\w'’]*[^\W\d_]"
_NAMES = frozenset(_GENDER_OF)
_TITLE = "|".join(w for words in _TITLES.values() for w in words)
_FIRST = "|".join(w for words in _GIVEN.values() for w in words)

_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[^\W\d_]{2,}")
_SECRET = re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)\s*[=:]\s*[\"']?(?P<value>[\w+/=.~-]{6,})")
_KEY = re.compile(r"\b(?P<value>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})")
_NUMBERS = {
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w+-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w])"),
}
_PERSON = re.compile(rf"\b(?:(?P<title>{_TITLE})\.? {_CAPITAL}(?: {_CAPITAL}){{0,2}}|(?:{_FIRST}) {_CAPITAL})\b")
_DIGIT = re.compile(r"\d")
_POSSESSIVE = re.compile(r"['’]s$", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += sum(divmod(2 * d, 10)) if i % 2 else d
    return total % 10


def _script(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[:1] <= "ӿ" else "greek" if "Ͱ" <= word[:1] <= "Ͽ" else "latin"


def _named(text: str) -> bool:
    """Whether a title or a given name occurs as a run of letters, without which the pattern for persons cannot match."""
    return not _NAMES.isdisjoint(_LETTERS.findall(text))


def _matches(text: str) -> Iterator[tuple[str, re.Match[str]]]:
    """Matches by kind, the more telling kinds first; patterns run only where the text has what they need."""
    if "@" in text:
        yield from (("email", m) for m in _EMAIL.finditer(text))
    if "=" in text or ":" in text:
        yield from (("secret", m) for m in _SECRET.finditer(text))
    if "AKIA" in text or "gh" in text and "_" in text or "sk-" in text:
        yield from (("secret", m) for m in _KEY.finditer(text))
    if _DIGIT.search(text):
        for kind, pattern in _NUMBERS.items():
            yield from ((kind, m) for m in pattern.finditer(text))
    if _named(text):
        yield from (("person", m) for m in _PERSON.finditer(text))


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """``(start, end, type, canonical form)`` of every mention, from left to right and without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    surnames: set[str] = set()

    def free(start: int, end: int) -> bool:
        at = bisect(taken, (start, end))
        if at and taken[at - 1][1] > start or at < len(taken) and taken[at][0] < end:
            return False
        taken.insert(at, (start, end))
        return True

    for kind, m in _matches(text) if text else ():
        start, end = m.span("value") if kind == "secret" else m.span()
        if not free(start, end):
            continue
        value = text[start:end]
        if kind == "email":
            found.append((start, end, kind, value.lower()))
        elif kind == "person":
            words = [(w.start() + start, w.end() + start, w[0]) for w in re.finditer(r"[\w'’]+", value)]
            gender = _GENDER_OF.get(words[0][2], "n")
            words = words[1:] if m["title"] else words
            for i, (a, b, word) in enumerate(words):
                given = i < len(words) - 1
                if not given:
                    word = _POSSESSIVE.sub("", word)
                    b = a + len(word)
                    surnames |= {word, word.upper(), word.capitalize()}
                gender_here = _GENDER_OF.get(word, gender) if given else "n"
                found.append((a, b, f"given-{gender_here}-{_script(word)}" if given else f"surname-{_script(word)}", word.lower()))
        elif kind in ("iban", "ssn", "card", "phone"):
            found.append((start, end, kind, re.sub(r"[^A-Z0-9]", "", value)))
        else:
            found.append((start, end, kind, value))
    if surnames:  # alone, anywhere in the text, they refer to the same person
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(surnames)))})(?!\w)", text):
            if free(*m.span()):
                found.append((*m.span(), f"surname-{_script(m[0])}", m[0].lower()))
    return sorted(found)


class _Draw:
    """Numbers from a keyed digest."""

    def __init__(self, key: str, kind: str, canonical: str, attempt: int) -> None:
        self.state, self.rest = hmac.new(key.encode(), f"{kind}\0{canonical}\0{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), 0
        self.pool = int.from_bytes(self.state, "big")

    def below(self, n: int) -> int:
        self.rest += 1
        if self.rest % 16 == 0:
            self.state = hashlib.sha256(self.state).digest()
            self.pool = int.from_bytes(self.state, "big")
        self.pool, out = divmod(self.pool, n)
        return out

    def digits(self, like: str) -> str:
        return "".join(str(1 + self.below(9)) if i == 0 and c != "0" else str(self.below(10)) if i else "0" for i, c in enumerate(like))

    def characters(self, like: str) -> str:
        hexadecimal = re.fullmatch("(?=.*[a-f])[0-9a-f]+", like) is not None
        out = []
        for c in like:
            if c.isdigit() or hexadecimal:
                out.append("0123456789abcdef"[self.below(16 if hexadecimal else 10)])
            elif c.isalpha():
                consonants, vowels, _ = _SOUNDS[_script(c.lower())]
                letter = (consonants + vowels)[self.below(len(consonants + vowels))]
                out.append(letter.upper() if c.isupper() else letter)
            else:
                out.append(c)
        return "".join(out)


def draw(key: str, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of a surrogate: of the same type and form, another for each attempt."""
    source = _Draw(key, kind, canonical, attempt)
    grown = max(0, attempt - _STRICT + 1)
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        host = _Draw(key, "domain", domain, 0)
        return source.characters(local + "x" * grown) + "@" + ".".join([*(host.characters(x) for x in labels[:-1]), labels[-1]])
    if kind == "ip":
        low_high = [(1, 9), (10, 99), (100, 254)]
        octets = [(1, 254) if grown else low_high[len(o) - 1] for o in canonical.split(".")]
        return ".".join(str(a + source.below(b - a + 1)) for a, b in octets)
    if kind == "card":
        body = canonical[0] + source.digits("1" + canonical[2:-1] + "1" * grown)
        wanted = 0 if _luhn(canonical) == 0 else 1 + source.below(9)
        return next(body + str(d) for d in range(10) if _luhn(body + str(d)) == wanted)
    if kind == "iban":
        body = source.characters(canonical[4:] + "1" * grown)
        number = "".join(str(int(c, 36)) for c in body + canonical[:2] + "00")
        return f"{canonical[:2]}{98 - int(number) % 97:02d}{body}"
    if kind in ("phone", "ssn"):
        return source.digits(canonical + "1" * grown)
    if kind.startswith(("given", "surname")):
        parts = kind.split("-")
        consonants, vowels, endings = _SOUNDS[parts[-1]]
        syllables = [consonants[source.below(len(consonants))] + vowels[source.below(len(vowels))] for _ in range(2 + source.below(2) + grown)]
        choice = endings.get(parts[1], [consonants[source.below(len(consonants))]])
        return "".join(syllables) + choice[source.below(len(choice))]
    return source.characters(canonical + "x" * grown)


def render(mention: str, kind: str, surrogate: str) -> str:
    """A surrogate written as the mention is: its separators and its case."""
    if kind.startswith(("given", "surname")):
        return surrogate.upper() if mention.isupper() and len(mention) > 1 else surrogate.capitalize()
    if kind == "email":
        return surrogate.upper() if mention.isupper() else surrogate
    if kind not in ("iban", "ssn", "card", "phone"):
        return surrogate
    rest = iter(surrogate)
    out = [next(rest, "") if c.isalnum() else c for c in mention]
    return "".join(out) + "".join(rest)


def mentions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, text_hash, start, end, kind, canonical)`` of every mention."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, h, *m) for i, h, t in zip(*(c.to_pylist() for c in batch.columns)) for m in detect(t)]
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "text_hash", "start", "end", "kind", "canonical"])

    source = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, "doc_id string, text_hash long, start int, end int, kind string, canonical string")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, canonical, surrogate)`` for distinct ``entities (kind, canonical)``; no two of a kind share a surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            drawn = [draw(key, kind, canonical, attempt) for kind, canonical, attempt in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], names=["kind", "canonical", "attempt", "surrogate"])

    settled: DataFrame | None = None
    pending = entities.select("kind", "canonical", F.lit(0).alias("attempt"))
    taken = entities.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("taken"))
    while True:
        drawn = pending.mapInArrow(run, "kind string, canonical string, attempt int, surrogate string")
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy(F.xxhash64("canonical"), "canonical")) == 1
        drawn = drawn.withColumn("first", first).join(taken, ["kind", "surrogate"], "left")
        drawn = stage(drawn.withColumn("ok", F.col("first") & F.col("taken").isNull()), "drawn")
        good = drawn.where("ok").select("kind", "canonical", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        taken = taken.unionByName(good.select("kind", "surrogate", F.lit(True).alias("taken")))
        pending = drawn.where("not ok").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return settled


def pseudonymise(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_column`` and ``n_replaced``, the number of replaced mentions."""
    docs = docs.drop("n_replaced")
    found = stage(mentions(docs, id_column, text_column).distinct(), "mentions")
    surrogates = assign(stage(found.select("kind", "canonical").distinct(), "entities"), key)
    edits = found.join(surrogates, ["kind", "canonical"]).groupBy("doc_id", "text_hash")
    edits = edits.agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("__edits"))
    edits = edits.select(F.col("doc_id").alias("__edits_id"), F.col("text_hash").alias("__edits_hash"), "__edits")
    same = F.col(id_column).cast("string").eqNullSafe(F.col("__edits_id")) & (F.xxhash64(text_column) == F.col("__edits_hash"))
    joined = docs.join(edits, same, "left").select(*[docs[c] for c in docs.columns], "__edits")
    names, where = docs.columns, docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, changes in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist()):
                counts.append(len(changes or ()))
                if changes:
                    parts, at = [], 0
                    for change in changes:
                        mention = text[change["start"] : change["end"]]
                        parts += [text[at : change["start"]], render(mention, change["kind"], change["surrogate"])]
                        at = change["end"]
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64())]
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_replaced"])

    return joined.mapInArrow(run, StructType([*docs.schema.fields]).add("n_replaced", LongType()))


def op2_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key="emberlake").select("doc_id", "text", "n_replaced")
