"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

The vocabulary is a ``tokenizers`` file of a lower-casing BPE whose words end in a suffix. Texts are cut at
the special tokens, normalised (NFC, white space, lower case character by character), split into words, and every
distinct word is encoded once per task: the automaton gives the longest token from each position; a token
is taken if it can stand beside the one before it, else the next shorter token that is its prefix is tried, else
the last token is taken back. Whether two tokens can stand side by side is read from a table of pairs that is
filled by undoing the merges of both tokens from the latest to the earliest: a pair fails if a merge
across the border would have come first. The result equals applying the merges in order.

Decoding joins the token strings with single spaces (the file names no decoder): they are taken from one byte buffer
by an offset table.

Edge cases: null and empty texts have no tokens and decode to the empty text; repeated rows are encoded each; an
empty table gives an empty result; other columns pass through, except that given names of outputs are replaced.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

_END = "\n"  # stands for the suffix at the end of a word; no token has a raw line feed
_MAX_WORDS = 150_000  # of the per-task tables of encoded words and chunks; a table starts anew when full
_MAX_PAIRS = 300_000
_ROWS = 1_000  # coded at once, so that a task holds few texts as Python strings
# The Unicode characters of the property White_Space.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
# Python's str.split() also cuts at these, which are no white space in Unicode.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Codec:
    """Automaton, pair table and token strings of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, number in self.special.items():
            vocab.setdefault(token, number)
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.find_words = regex.compile(pattern).findall
        self.letters = dict(enumerate(_byte_letters()))
        self.automaton = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        keys: dict[str, int] = {}
        for token, number in vocab.items():
            if token in self.special:
                continue
            key = token[: -len(self.suffix)] + _END if token.endswith(self.suffix) and token != self.suffix else token
            keys[key] = number
            self.length[number] = len(key)
            self.automaton.add_word(key, (len(key), number))
        self.automaton.make_automaton()
        # The longest token that is a proper prefix of a token: where a rejected token falls back to.
        self.shorter = {n: next((keys[k[:i]] for i in range(len(k) - 1, 0, -1) if k[:i] in keys), -1) for k, n in keys.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for order, merge in enumerate(model["merges"]):
            first, second = merge.split(" ") if isinstance(merge, str) else merge
            pair = (vocab[first], vocab[second])
            self.rank[pair] = order
            self.parts[vocab[first + second]] = (*pair, order)
        self.pairs: dict[int, bool] = {}  # by left << 32 | right
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the tables that have filled while coding: a worker stays when its task is done, and others run beside it."""
        for table in (self.pairs, self.words, self.chunks):
            table.clear()

    def fits(self, left: int, right: int) -> bool:
        """Whether merging ``left``'s and ``right``'s symbols in order leaves the border between them."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= _MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._border_stays(left, right)
        return known

    def _border_stays(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges. Pieces at the border stand there until the undone merge came, so a merge
        # across the border wins if it comes before it; of equal ranks the one further left is made first.
        never = len(self.rank)
        bound, wins_ties = never, False
        while True:
            across = self.rank.get((left, right))
            if across is not None and (across < bound or across == bound and wins_ties):
                return False
            a, b = self.parts.get(left, (0, 0, -1)), self.parts.get(right, (0, 0, -1))
            if a[2] < 0 and b[2] < 0:
                return True
            if a[2] > b[2]:
                bound, wins_ties, left = a[2], False, a[1]
            else:
                bound, wins_ties, right = b[2], True, b[0]

    def encode_word(self, word: str) -> list[int]:
        """The tokens of one word, without its suffix in ``word``."""
        # Visible ASCII letters stand for themselves; words hold no spaces or line ends.
        text = (word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)) + _END
        size, known = len(text), self.pairs.get
        found = [match for _, match in self.automaton.iter_long(text)]
        tokens = [number for _, number in found]
        if sum([length for length, _ in found]) == size:
            # Always the longest match: the encoder's first way down, and its result if all neighbours fit.
            for left, right in zip(tokens, tokens[1:]):
                fit = known(left << 32 | right)
                if not (self.fits(left, right) if fit is None else fit):
                    break
            else:
                return tokens
        longest = [(0, -1)] * (size + 1)
        for end, found in self.automaton.iter(text):
            start = end - found[0] + 1
            if found[0] > longest[start][0]:
                longest[start] = found
        tokens = []
        usable = [True] * (size + 1)
        at, token = 0, longest[0][1]
        while at < size:
            if token >= 0:
                end = at + self.length[token]
                if usable[end] and (not tokens or self.fits(tokens[-1], token)):
                    tokens.append(token)
                    at, token = end, longest[end][1]
                else:
                    token = self.shorter[token]
            elif tokens:
                usable[at] = False
                token = tokens.pop()
                at -= self.length[token]
            else:
                raise ValueError(f"no tokens for the word {word!r}")
        return tokens

    def _encode_chunk(self, chunk: str) -> bytes:
        """The ids of what stands between two white spaces; words never cross them."""
        words, out = self.words, []
        for word in self.find_words(chunk):
            code = words.get(word)
            if code is None:
                code = array("i", self.encode_word(word)).tobytes()
                if len(word) <= 64:
                    if len(words) >= _MAX_WORDS:
                        words.clear()
                    words[word] = code
            out.append(code)
        return b"".join(out)

    def _add_piece(self, piece: str, out: list[bytes]) -> None:
        text = unicodedata.normalize("NFC", piece)
        # Character by character: str.lower() alone would choose the final form of a sigma by its neighbours.
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        chunks, encode_chunk = self.chunks, self._encode_chunk
        for chunk in _SPACE.split(text) if _SEPARATORS.search(text) else text.split():
            code = chunks.get(chunk)
            if code is None:
                code = encode_chunk(chunk)
                if len(chunk) <= 64:
                    if len(chunks) >= _MAX_WORDS:
                        chunks.clear()
                    chunks[chunk] = code
            out.append(code)

    def encode(self, text: str | None) -> bytes:
        """The token ids of a text as the bytes of 32-bit integers."""
        out: list[bytes] = []
        if not text:
            return b""
        if self.special_cut is None or "<" not in text:
            self._add_piece(text, out)
        else:
            for piece in self.special_cut.split(text):
                if piece in self.special:
                    out.append(np.int32(self.special[piece]).tobytes())
                elif piece:
                    self._add_piece(piece, out)
        return b"".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def token_strings(path: str) -> pa.StringArray:
    """All token strings by id: one byte buffer and its offset table."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    numbers = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    strings = [""] * (max(numbers.values()) + 1)
    for token, number in numbers.items():
        strings[number] = token
    return pa.array(strings)


def encode(docs: DataFrame, vocab_path: str, text_column: str = "text", output: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text_column`` as an ``array<int>``. ``vocab_path`` must exist on every executor."""
    kept = docs.drop(output)
    schema = StructType([*kept.schema.fields]).add(output, ArrayType(IntegerType(), False), False)
    names, where = [*kept.columns, output], kept.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                coded = [codec(vocab_path).encode(t) for t in batch.column(where).to_pylist()]
                offsets = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=names)
        codec(vocab_path).forget()

    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, vocab_path: str, ids_column: str = "ids", output: str = "decoded") -> DataFrame:
    """``coded`` with the text of the token ids in ``ids_column``."""
    kept = coded.drop(output)
    schema = StructType([*kept.schema.fields]).add(output, StringType(), False)
    names, where = [*kept.columns, output], kept.columns.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = token_strings(vocab_path)  # taking ids copies the slices that the offsets name
        for batch in batches:
            column = batch.column(where)
            sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            done, at = np.cumsum(sizes), 0
            while at < batch.num_rows:  # half a million tokens at a time
                end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + 500_000, "right")))
                offsets = pa.array(np.r_[0, np.cumsum(sizes[at:end])].astype(np.int32))
                tokens = strings.take(column.slice(at, end - at).flatten().cast(pa.int32()))
                texts = pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, texts], names=names)
                at = end

    return kept.mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, default_vocabulary()).select("doc_id", "ids")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    coded = coded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(joined, 256)})
    return decode(coded, default_vocabulary()).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
