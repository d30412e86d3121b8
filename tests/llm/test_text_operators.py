"""Tests of the operators that work on each text: toxicity, tokens, languages, pages, rules, personal data."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlake.llm import bpe, decontaminate, host_rules, html_text, language, surrogates, toxicity

FOLDER = "/root/testdata/sf0.001"
LONG = "lorem ipsum " * 20_000


def documents(spark, rows, schema="doc_id long, text string, lang string, source string, ids string, edits string, words string"):
    """Rows of ``(doc_id, text)`` with further columns whose names the operators use inside."""
    width = len(schema.split(",")) - 2
    return spark.createDataFrame([(i, t, *["x"] * width) for i, t in rows], schema)


MESSY = [(1, None), (2, ""), (3, LONG), (4, "same"), (4, "same"), (None, "no id"), (5, "\x00   ÀÉ 日本 🎉")]


class TestTokens:
    def codec(self):
        return bpe.Codec(bpe.default_vocabulary())

    def library(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(bpe.default_vocabulary())
        found.no_truncation()
        found.no_padding()
        return found

    def test_same_as_the_library(self, spark):
        texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
        texts += ["", " ", "ΑΣ Σ'S it's I'LL ½² <|endoftext|>x<|startoftext|>", "aaaaaaaaaaaaaaaa", "....!!!!", "\x1c\x85\xa0é İ", "don't'll", "<<|endoftext|>>"]
        found = self.codec(), self.library()
        for text in texts:
            ids = [int.from_bytes(b, "little") for b in map(bytes, zip(*[iter(found[0].encode(text))] * 4))]
            assert ids == found[1].encode(text, add_special_tokens=False).ids, text

    def test_messy_rows_and_decoding(self, spark):
        docs = documents(spark, MESSY)
        coded = bpe.decode(bpe.encode(docs, bpe.default_vocabulary()), bpe.default_vocabulary())
        assert coded.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"]
        library, rows = self.library(), coded.collect()
        assert len(rows) == len(MESSY)
        for row in rows:
            ids = library.encode(row.text or "", add_special_tokens=False).ids
            assert (row.ids, row.decoded) == (ids, library.decode(ids, skip_special_tokens=False))

    def test_query_digests(self, spark):
        library = self.library()
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
        for row in bpe.op6_bpe(spark, FOLDER).limit(20).collect():
            ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
            assert row.n_tokens == len(ids)
            assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()

    def test_empty_table(self, spark):
        assert bpe.encode(documents(spark, []), bpe.default_vocabulary()).count() == 0

    def test_a_worker_keeps_no_coded_words(self, spark):
        path = bpe.default_vocabulary()
        assert bpe.encode(documents(spark, [(i, f"word{i} other words") for i in range(40)]).repartition(8), path).count() == 40

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([len(bpe.codec(path).words) + len(bpe.codec(path).chunks)] * batch.num_rows)], names=["n"])

        assert {r.n for r in spark.range(0, 16, 1, 8).mapInArrow(run, "n long").collect()} == {0}


class TestToxicity:
    def test_fold(self):
        assert toxicity.fold("  1D10T  іdiоt\n$tupid 2024 ") == "idiot idiot stupid 2024"
        assert toxicity.fold(None) == ""

    def test_exception_takes_the_hit_back(self):
        model = toxicity.Model({"clown": 5.0}, {"vequ": 4.0}, ["clown fish"], (-5.0, 1.0, 2.0))
        matcher = model.matcher()
        assert toxicity.hits("a clown here", matcher) == [(2, 7, 5.0)]
        assert toxicity.hits("a clown fish", matcher) == []
        assert toxicity.hits("clowns vequx", matcher) == [(7, 11, 4.0)]

    def test_learns_and_holds_out(self, spark):
        folder = "/root/testdata/sf0.01"
        labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        rows = toxicity.op4_toxicity(spark, folder).join(labels, "doc_id").collect()
        hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
        assert hit > 0.5 * sum(r.toxic == 1 for r in rows)
        assert sum(r.predicted == 1 and r.toxic == 0 for r in rows) <= 0.02 * len(rows)
        assert all(0 <= r.score <= 1 for r in rows)

    def test_messy_rows(self, spark):
        docs = documents(spark, MESSY)
        labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (4, 1)], "doc_id long, toxic int")
        model = toxicity.learn(docs, labels)
        assert model.words == {}
        assert toxicity.score(docs, model).where("score < 1e-9").count() == len(MESSY)
        assert toxicity.drop_toxic(docs, model).count() == len(MESSY)
        assert toxicity.score(documents(spark, []), model).count() == 0


class TestLanguage:
    def test_held_out_accuracy(self, spark):
        folder = "/root/testdata/sf0.01"
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
        found = language.op7_language(spark, folder).join(docs, "doc_id").where("held_out")
        share = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
        assert share > 0.98

    def test_messy_rows(self, spark):
        rows = [(i, t, "en") for i, t in [(1, "the cat and the dog"), (2, "of the and"), (6, None), (7, " 12 !")]] + [(8, "der die und das", "de"), (9, "ohne", None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language.learn(docs)
        found = {r.doc_id: r for r in language.identify(docs, model).collect()}
        assert (found[6].lang_pred, found[6].score, found[7].lang_pred) == ("und", 0.0, "und")
        assert found[1].lang_pred == "en" and found[8].lang_pred == "de"
        assert language.identify(documents(spark, MESSY), model).count() == len(MESSY)
        assert language.Model().predict("abc") == ("und", 0.0)

    def test_letters_in_long_texts_count_once(self):
        size = language._BLOCK
        language._BLOCK = 64
        try:
            cut = language.features("abc déf gh " * 50)
        finally:
            language._BLOCK = size
        assert abs(cut - language.features("abc déf gh " * 50)).max() < 1e-6


class TestPages:
    def test_article_only(self):
        page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header>
        <div class="cookie-notice">We use cookies, fine.</div><article><h1>Title</h1><p>First &amp; foremost, a
        text. It goes on.<p>Second, with <a href=x>a link</a>; more text.</p><!-- no --><script>var a="<p>no</p>"</script>
        <div class="comments"><p>Nice one, I liked it, really. Thanks!</p></div></article><aside>Side, text.</aside>
        <form><p>Name</p></form><footer>&copy; Site</footer></body></html>"""
        assert html_text.main_text(page) == "Title\nFirst & foremost, a text. It goes on.\nSecond, with a link; more text."

    @pytest.mark.parametrize("page", [None, "", "<p", "<<<>>>", "<script>x", "&#0;", "</p></div>", "<a " + "x=' " * 2000])
    def test_broken_pages(self, page):
        assert isinstance(html_text.main_text(page), str)

    def test_messy_rows(self, spark):
        pages = spark.createDataFrame([(1, None, "u"), (2, "<p>Hello there, world.</p>", "v")], "page_id long, html string, text string")
        rows = {r.page_id: r.text for r in html_text.extract(pages).collect()}
        assert rows == {1: "", 2: "Hello there, world."}

    @pytest.mark.parametrize("head, tail", [
        ('<html><body class="no-sidebar"><div>', "</div></body></html>"), ('<article class="post comments-open">', "</article>"),
        ('<main role="search">', "</main>"), ('<div class="content header-fixed">', "</div>"), ('<html class="cookie-ok"><body><div id="share">', "</div></body>"),
    ])
    def test_marker_words_do_not_take_the_article(self, head, tail):
        page = f'{head}<h1><a href="x">A linked title</a></h1><p>First, a text. It goes on, and on.</p><p>Second, a text. It ends here.</p>{tail}'
        assert html_text.main_text(page) == "A linked title\nFirst, a text. It goes on, and on.\nSecond, a text. It ends here."

    def test_parts_inside_the_article_stay(self):
        page = """<body><article><h2 id="related-work">Related</h2><div><p>First, a long text. It goes on, and on, and on, as texts do.</p>
        <p>Second, a long text. It goes on, and on, and on.</p></div><figure><figcaption>A caption.</figcaption></figure><p>With <math><mi>x</mi><mo>=</mo><mn>1</mn></math> in it.</p>
        <ul><li><a href="x">An item, linked</a></li></ul></article><div class="related"><p>Another one, short.</p></div></body>"""
        text = html_text.main_text(page).split("\n")
        assert text[0] == "Related" and text[3:] == ["A caption.", "With x=1 in it.", "An item, linked"]

    def test_all_articles(self, spark):
        from html import unescape
        import re

        for row in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
            article = row.html[row.html.index("<article>") + 9 : row.html.index("</article>")]
            blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", article)]
            assert html_text.main_text(row.html) == "\n".join(b for b in blocks if b)


class TestNamesInTexts:
    @pytest.mark.parametrize("text", ["Author:Jane Smith", ">Jane Smith", "—John Doe", "a|Mr Jones", "x,Dr. Jones", "…Анна Каренина"])
    def test_names_after_any_sign(self, text):
        assert any(kind.startswith("surname") for _, _, kind, _ in surrogates.detect(text))

    def test_a_surname_alone_is_replaced_alike(self, spark):
        text = "Smith came. John Smith's car; SMITH again, Smithson and Smith. Blacksmith, smith@a.org."
        found = surrogates.detect(text)
        assert [text[a:b] for a, b, kind, c in found if (kind, c) == ("surname-latin", "smith")] == ["Smith", "Smith", "SMITH", "Smith"]
        row = surrogates.pseudonymise(documents(spark, [(1, text)]), key="k").first()
        words = row.text.replace("'s", "").replace(".", "").replace(",", "").split()
        assert "Smith " not in row.text and "SMITH" not in row.text and "Smithson" in row.text and "Blacksmith" in row.text
        assert words[0] == words[3] == words[9] and words[5] == words[0].upper() and row.n_replaced == 6


class TestRules:
    def test_repeat_words(self, spark):
        def brute(text):
            words = (text or "").split()
            windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
            return len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)})

        texts = [None, "", "a", "a a a", "a a a a", "a b c a b c", "a b c d a b c", "x y z " * 30 + "q", "one two\nthree\x0bfour"]
        rows = host_rules.document_rules(documents(spark, list(enumerate(texts)))).collect()
        assert {r.doc_id: r.n_repeat_words for r in rows} == {i: brute(t) for i, t in enumerate(texts)}

    def test_hosts(self, spark):
        good, bad = " ".join(f"w{i}" for i in range(60)), "few words"
        rows = [(i, good, "a") for i in range(40)] + [(100 + i, bad if i < 38 else good, "b") for i in range(40)] + [(200, good, None), (201, None, None)]
        found = {r.doc_id: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert len(found) == len(rows)
        assert found[0].kept and not found[139].kept and not found[139].base_failed and found[201].base_failed
        assert found[0].shrunk_rate > 0

    def test_messy_rows(self, spark):
        assert host_rules.judge(documents(spark, MESSY)).count() == len(MESSY)
        assert host_rules.judge(documents(spark, [])).count() == 0


class TestSurrogates:
    TEXT = "Mrs Jane Smith (a.b@Mail.example.com) paid with 4111 1111 1111 1111 from 10.1.22.254; call +1 (415) 555-2671. Smith again."

    def test_forms(self):
        for start, end, kind, canonical in surrogates.detect(self.TEXT):
            mention = self.TEXT[start:end]
            drawn = surrogates.render(mention, kind, surrogates.draw("k", kind, canonical, 0))
            assert drawn != mention
            if kind == "card":
                assert [c.isdigit() for c in drawn] == [c.isdigit() for c in mention] and surrogates._luhn(drawn.replace(" ", "")) == 0
            if kind == "ip":
                assert [len(p) for p in drawn.split(".")] == [len(p) for p in mention.split(".")]

    def test_coreference_and_distinctness(self, spark):
        rows = [(1, self.TEXT), (2, "Again Mrs Jane Smith, 4111-1111-1111-1111."), (3, None), (4, ""), (None, "mail a.b@mail.example.com"), (5, "mail c.d@mail.example.com"), (5, "mail c.d@mail.example.com")]
        docs = documents(spark, rows)
        found = surrogates.pseudonymise(docs, "key")
        assert found.columns == [*docs.columns, "n_replaced"]
        texts = {r.doc_id: r.text for r in found.collect()}
        assert found.count() == len(rows) and texts[3] is None and texts[4] == ""
        for value in ("Jane", "Smith (", "4111", "10.1.22.254", "555-2671", "a.b@"):
            assert all(value not in (t or "") for t in texts.values())
        name = texts[1].split(" (")[0].removeprefix("Mrs ")
        assert f"Again Mrs {name}," in texts[2]
        assert texts[None].removeprefix("mail ") in texts[1].lower()
        assert texts[None] != texts[5]

    def test_collisions_are_drawn_again(self, spark):
        # One-digit octets leave 6561 addresses; 3000 of them must stay apart from each other and from the originals.
        rows = [("ip", f"{1 + i % 9}.{1 + i // 9 % 9}.{1 + i // 81 % 9}.{1 + i // 729 % 9}") for i in range(3000)]
        found = surrogates.assign(spark.createDataFrame(rows, "kind string, canonical string"), "key").collect()
        assert len(found) == len({r.surrogate for r in found}) == 3000
        assert not {r.surrogate for r in found} & {c for _, c in rows}

    def test_empty_table(self, spark):
        assert surrogates.pseudonymise(documents(spark, []), "key").count() == 0


class TestDecontamination:
    ITEMS = [(1, "What does the quick brown fox jump over in the old tale? It jumps over the lazy sleeping dog."), (2, None), (3, "..."), (4, "Name the capital city of the northern country of lakes and woods? Helsinki.")]

    def items(self, spark):
        return spark.createDataFrame(self.ITEMS, "item_id long, text string")

    def test_finds_whole_items_only(self, spark):
        filler = " ".join(f"filler{i}" for i in range(300))
        rows = [(1, f"{filler} {self.ITEMS[0][1].upper()} {filler}"), (2, filler), (3, "What does the quick brown fox jump over in the old tale? Nothing."), (4, None), (5, ""), (6, self.ITEMS[3][1]), (6, self.ITEMS[3][1])]
        docs = documents(spark, rows)
        found = decontaminate.find(docs, self.items(spark)).collect()
        assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (6, 4), (6, 4)]
        assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, self.items(spark)).collect()) == [2, 3, 4, 5]

    def test_no_items(self, spark):
        none = spark.createDataFrame([], "item_id long, text string")
        assert decontaminate.find(documents(spark, MESSY), none).count() == 0
        assert decontaminate.drop_contaminated(documents(spark, MESSY), none).count() == len(MESSY)

    def test_bounds_lose_nothing(self, spark):
        import random

        index = next(decontaminate.indexes(spark.read.parquet(f"{FOLDER}/benchmark.parquet")))
        draw = random.Random(5)
        for _ in range(200):
            words = [w for _, t in draw.sample(index.items, 2) for w in decontaminate.words(t)[: draw.randint(3, 60)]]
            terms = sorted({index.vocabulary[w] for w in words})
            scores = {}
            for term in terms:
                for block in index.postings[term].values():
                    for number, impact in block:
                        scores[number] = scores.get(number, 0.0) + impact
            assert {n for n, s in scores.items() if s >= decontaminate.RETRIEVE - 1e-9} == {n for n, _ in index.retrieve(terms)}
