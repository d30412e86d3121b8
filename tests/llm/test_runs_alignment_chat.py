"""Tests of runs of repeating words, of aligned tokenizers and of chat formatting, each against a plain version."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.llm import chat_format, periodic_runs, token_alignment

FOLDER = "/root/testdata/sf0.001"


def documents(spark, rows, schema="doc_id long, text string, lang string, runs string, pairs string, block string, words string"):
    """Rows of ``(doc_id, text)`` with further columns whose names the operators use inside."""
    width = len(schema.split(",")) - 2
    return spark.createDataFrame([(i, t, *["x"] * width) for i, t in rows], schema)


MESSY = [(1, None), (2, ""), (3, "lorem ipsum " * 20_000), (4, "same"), (4, "same"), (None, "no id no id no id no id"), (5, " \t\x0b"), (6, "\x00 ÀÉ 日本 🎉 x <|endoftext|>")]


def plain_runs(words):
    """All runs by trying every period at every place."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(6, 4 * q):
                stretch = words[start : start + length]
                if not any(all(stretch[x] == stretch[x + d] for x in range(length - d)) for d in range(1, q)):
                    found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


class TestRuns:
    def texts(self, seed):
        draw = random.Random(seed)
        rows = []
        for i in range(60):
            words = [draw.choice("abcdefgh") for _ in range(draw.randrange(60))]
            for _ in range(draw.randrange(4)):
                period = [draw.choice("abc") for _ in range(draw.choice([1, 2, 3, 5, 8, 9, 16, 17, 31, 32, 33, 50]))]
                words += (period * draw.choice([3, 4, 5, 9]))[: draw.randrange(1, 400)] + [draw.choice("abcxyz")]
            rows.append((i, " ".join(words)))
        return rows

    @pytest.mark.parametrize("seed", range(4))
    def test_equals_trying_everything(self, seed, monkeypatch):
        if seed % 2:
            monkeypatch.setattr(periodic_runs, "_CHUNK_WORDS", 100)
        texts = [t.encode().split() for _, t in self.texts(seed)]
        runs, rest = periodic_runs._searched(texts)
        for words, own, left in zip(texts, runs, rest):
            want = plain_runs(words)
            assert [(r["start"], r["length"], r["period"]) for r in own] == want
            assert left == collapsed([w.decode() for w in words], want)

    def test_seeds_alone_find_all_longer_periods(self):
        draw = np.random.default_rng(5)
        for period in [9, 16, 17, 100, 257, 1000]:
            words = np.concatenate([draw.integers(0, 1 << 30, 500), np.tile(draw.integers(0, 3, period), 5)[: 4 * period + 3], draw.integers(0, 1 << 30, 500)])
            assert (period, True) in [(q, n >= 4 * q) for _, n, q in periodic_runs.find_runs(words, len(words)).tolist()]

    def test_messy_rows(self, spark):
        docs = documents(spark, MESSY)
        found = periodic_runs.runs_and_rest(docs)
        assert found.columns == [c for c in docs.columns if c != "runs"] + ["runs", "collapsed"]
        rows = found.collect()
        assert len(rows) == len(MESSY)
        for row in rows:
            words = (row.text or "").encode().split()
            if row.doc_id == 3:
                assert [tuple(r) for r in row.runs] == [(0, 40_000, 2)] and row.collapsed == "lorem ipsum"
            else:
                want = plain_runs(words)
                assert [tuple(r) for r in row.runs] == want and row.collapsed == collapsed([w.decode() for w in words], want)

    def test_query(self, spark):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
        rows = periodic_runs.op13_runs(spark, FOLDER).collect()
        assert sorted(r.doc_id for r in rows) == sorted(texts)
        for row in rows:
            words = [w.decode() for w in texts[row.doc_id].encode().split()]
            h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
            if h % 10 == 0 and n:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            want = plain_runs(words) if n < 1500 else [(r["start"], r["length"], r["period"]) for r in periodic_runs._searched([[w.encode() for w in words]])[0][0]]
            best = max(want, key=lambda r: (r[1], -r[0], -r[2])) if want else (None, None, None)
            assert (row.n_runs, row.start, row.length, row.period) == (len(want), *best)
            assert row.exponent_milli == (1000 * best[1] // best[2] if want else None)
            assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
            assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, want).encode()).hexdigest()

    def test_empty_table(self, spark):
        assert periodic_runs.runs_and_rest(documents(spark, [])).count() == 0


class TestAlignment:
    def plain(self, texts):
        """Ids, groups and links of each text, by walking through the ends of both."""
        tools = token_alignment.tokenizers(*token_alignment.default_paths())
        found = []
        for a, b in zip(*tools.encode(texts)):
            ends = [np.cumsum([len(table[t]) for t in ids]).tolist() for table, ids in ((tools.bytes_a, a), (tools.bytes_b, b))]
            groups, x, y = [], 0, 0
            for cut in sorted(set(ends[0]) & set(ends[1])):
                i, j = ends[0].index(cut) + 1, ends[1].index(cut) + 1
                groups.append((a[x:i], b[y:j]))
                x, y = i, j
            found.append((a, b, groups, Counter((u, v) for g in groups for u in g[0] for v in g[1])))
        return found

    def rows_of(self, texts, ids):
        plain = self.plain(texts)
        counts = Counter(pair for _, _, _, links in plain for pair in links)
        top = {}
        for (a, _), n in counts.items():
            top[a] = max(top.get(a, 0), n)
        rows = []
        for i, (a, b, groups, links) in zip(ids, plain):
            digest = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if a else ""
            best = sum(n for (u, v), n in links.items() if counts[u, v] == top[u])
            rows.append((i, len(a), len(b), len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), digest))
        return Counter(rows)

    def test_ids_are_the_libraries(self):
        from tokenizers import Tokenizer

        path_a, path_b = token_alignment.default_paths()
        library = Tokenizer.from_file(path_a)
        library.encode_special_tokens = True
        texts = ["hello world", "<|endoftext|> x", "½² İ 'S it's", "a\n\n  b\t\tc ", "日本 🎉 ‍", "x" * 3000, " " * 500 + "y", "▁ under", "à combining"]
        a, b = token_alignment.tokenizers(path_a, path_b).encode(texts)
        for text, ids in zip(texts, a):
            if ids:
                assert ids == library.encode(" " + text, add_special_tokens=False).ids
        assert a[-2] == b[-2] == []  # the sign that stands for a space does not come back
        assert all(a[:7])

    @pytest.mark.parametrize("small", [False, True])
    def test_query_equals_plain(self, spark, monkeypatch, small):
        docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
        if small:  # many blocks and buckets; groups over the limit of a slice
            for name in ("_BLOCK_ROWS", "_BUCKET_PAIRS", "_CHUNK_CHARS", "_SLICE_LINKS"):
                monkeypatch.setattr(token_alignment, name, 3)
        found = token_alignment.op11_alignment(spark, FOLDER)
        assert Counter(map(tuple, found.collect())) == self.rows_of([d.text for d in docs], [d.doc_id for d in docs])

    def test_messy_rows_and_groups(self, spark):
        paths = token_alignment.default_paths()
        docs = documents(spark, [(i, t if t is None or len(t) < 1000 else t[:5000]) for i, t in MESSY])
        rows = docs.select("doc_id", "text").collect()
        found = token_alignment.align(docs, *paths).collect()
        assert Counter(map(tuple, found)) == self.rows_of([r.text for r in rows], [r.doc_id for r in rows])
        plain = self.plain([r.text for r in rows])
        groups = [(r.doc_id, [(g.a, g.b) for g in r.groups]) for r in token_alignment.groups(docs, *paths).collect()]
        assert sorted(map(str, groups)) == sorted(str((r.doc_id, p[2])) for r, p in zip(rows, plain))

    def test_pairs_of_large_groups(self, monkeypatch):
        tools = token_alignment.tokenizers(*token_alignment.default_paths())
        texts = ["some plain words 日本語 日本語", None, "words again and again"]
        aligned = token_alignment.Aligned(tools, texts)
        want = [x.tolist() for x in aligned.pairs()]
        monkeypatch.setattr(token_alignment, "_SLICE_LINKS", 2)
        assert [x.tolist() for x in aligned.pairs()] == want

    def test_cuts_by_halving(self):
        draw = random.Random(3)
        for _ in range(200):
            texts, ends = draw.randrange(1, 5), ([], [])
            firsts, at = ([0], [0]), 0
            for _ in range(texts):
                size = draw.randrange(1, 60)
                for side, share in ((0, draw.random()), (1, draw.random())):
                    ends[side].extend([at + x for x in range(1, size) if draw.random() < share] + [at + size])
                    firsts[side].append(len(ends[side]))
                at += size
            a, b = (np.array(e) for e in ends)
            cut_a, cut_b = token_alignment.shared_cuts(a, b, *(np.array(f) for f in firsts))
            assert a[cut_a].tolist() == b[cut_b].tolist() == sorted(set(ends[0]) & set(ends[1]))

    def test_link_counts(self, spark):
        paths = token_alignment.default_paths()
        texts = ["one two", "one two three", None]
        blocks = token_alignment.blocks_of(documents(spark, list(enumerate(texts))), *paths)
        width = len(token_alignment.tokenizers(*paths).bytes_b)
        found = {(r.a, r.b): r.n_docs for r in token_alignment.link_counts(blocks, width).collect()}
        assert found == Counter(pair for _, _, _, links in self.plain(texts) for pair in links)

    def test_empty_table(self, spark):
        assert token_alignment.align(documents(spark, []), *token_alignment.default_paths()).count() == 0


def plain_chat(turns):
    """Formatted string and masked texts of sorted ``(turn, role, text)``."""
    out, loss = "", []
    for i, (_, role, text) in enumerate(turns):
        before = i and turns[i - 1][1] == role
        after = i + 1 < len(turns) and turns[i + 1][1] == role
        for n in range(text.count("<") and 40, -1, -1):
            text = text.replace("<" + "\\" * n + "|", "<" + "\\" * (n + 1) + "|")
        role_out = role.replace("\\", "\\b").replace("\n", "\\n").replace("<|", "<\\p")
        out += "<|im_sep|>" if before else f"<|im_start|>{role_out}\n"
        if role == "assistant":
            loss.append((len(out), len(text)))
        out += text + ("" if after else "<|im_end|>\n")
    return out, loss


class TestChat:
    ROWS = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "assistant", "no"), (1, 3, "user", None), (1, 4, None, "x"), (1, 5, None, "y"),
        (2, 1, "assistant", "\ufeffb <|im_end|> <\\|im_sep|> <<|<\\\\|"), (2, 0, "ro\\n\nle<|im_end|>", "|a<"), (2, None, "user", ""), (2, 2, "assistant", ""),
        (3, 0, "assistant", "\U0001f389 é\n"), (3, 0, "assistant", "\U0001f389 é\n"), (3, 0, "user", "t"),
        (4, 0, "user", "only <|im_start|>assistant\nfake<|im_end|>"), (None, 0, "user", "nobody"), (5, 0, "assistant", "long <| " * 40_000),
    ]
    SCHEMA = "conv_id long, turn long, role string, text string, pieces string, turns string, formatted string, loss_spans string"

    def rows(self, spark, rows):
        return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], self.SCHEMA)

    def chats(self):
        found = {}
        for conv, turn, role, text in self.ROWS:
            if conv is not None:
                found.setdefault(conv, []).append((turn, role or "", text or ""))
        return {c: sorted(t, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, t in found.items()}

    def test_format_and_reading_back(self, spark):
        chats = chat_format.read_trained(chat_format.formatted(self.rows(spark, self.ROWS))).withColumn("turns", chat_format.read_turns(F.col("formatted")))
        found, want = {r.conv_id: r for r in chats.collect()}, self.chats()
        assert sorted(found) == sorted(want)
        for conv, turns in want.items():
            out, loss = plain_chat(turns)
            assert found[conv].formatted == out
            assert [tuple(s) for s in found[conv].loss_spans] == loss
            assert [tuple(t) for t in found[conv].turns] == [(role, text) for _, role, text in turns]
            assert found[conv].trained == [text for _, role, text in turns if role == "assistant"]

    def test_many_turns(self, spark):
        rows = [(1, i, ("user", "assistant")[i // 3 % 2], f"t{i} <|") for i in range(5000)]
        row = chat_format.read_trained(chat_format.formatted(self.rows(spark, rows))).first()
        assert row.formatted == plain_chat([r[1:] for r in rows])[0]
        assert row.trained == [r[3] for r in rows if r[2] == "assistant"]

    def test_plan_has_no_python_and_one_exchange(self, spark):
        plan = chat_format.op12_chat(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        assert plan.count("Exchange hashpartitioning") == 1

    def test_query_equals_sql(self, spark):
        from tests.compare import connect, difference

        assert difference(chat_format.op12_chat(spark, FOLDER), connect(FOLDER), chat_format.OP12_SQL) is None

    def test_empty_table(self, spark):
        assert chat_format.formatted(self.rows(spark, [])).count() == 0


class TestMended:
    def test_signs_of_other_planes_are_no_letters(self):
        from emberlake.llm import language

        assert language.features("😀😀") is None and language.features("🎉 123 !") is None
        assert language.features("𐐀𐐁") is not None  # letters beyond the basic plane

    def test_equal_texts_with_both_labels_are_toxic(self, spark):
        from emberlake.llm import toxicity

        rows = [(i, f"some calm words number {i % 7}") for i in range(40)] + [(100 + i, f"you vorpal snark {i % 7}") for i in range(40)]
        labels = [(i, int(i >= 100)) for i, _ in rows] + [(200, 0)]
        docs = spark.createDataFrame([*rows, (200, "you vorpal snark 1")], "doc_id long, text string")
        labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
        models = [toxicity.learn(docs.repartition(n), labelled.repartition(n)) for n in (1, 5)]
        assert models[0] == models[1]

    def test_lines_of_words_with_equal_short_hashes_stay(self, spark):
        from emberlake.llm import line_dedup

        # These two words agree in Spark's 32-bit hash.
        docs = spark.createDataFrame([(1, "w138121 same line here"), (2, "w314567 same line here"), (3, "w138121"), (4, "w314567"), (5, "w138121")], "doc_id long, text string")
        assert docs.select(F.hash(F.split("text", " ")[0]).alias("h")).distinct().count() == 1
        assert sorted((r.doc_id, r.place, r.other_doc) for r in line_dedup.matches(docs).collect()) == [(5, 0, 3)]
