"""Tests of the operators that compare documents: repeated strings, lines, near duplicates; and the pipeline."""

import hashlib
import os
import random
from importlib.util import find_spec

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake import session
from emberlake.llm import line_dedup, near_copies, simhash, suffix_dedup
from emberlake.llm.common import connected_components
from emberlake.llm.queries import QUERIES, SQL
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, place int, line string, fp string")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None


class TestRepeatedStrings:
    def brute(self, rows, window=suffix_dedup.WINDOW):
        first = {}
        for i, t in rows:
            b = (t or "").encode()
            for s in range(len(b) - window + 1):
                first[b[s : s + window]] = min(i, first.get(b[s : s + window], i))
        out = []
        for i, t in rows:
            b = (t or "").encode()
            gone = bytearray(len(b))
            for s in range(len(b) - window + 1):
                if first[b[s : s + window]] < i:
                    gone[s : s + window] = b"\1" * window
            spans = sum(1 for a, x in zip(b"\0" + bytes(gone), gone) if x and not a)
            out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest()))
        return sorted(out)

    def found(self, docs):
        rows = suffix_dedup.deduplicate(docs).collect()
        return sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows)

    def test_against_brute_force(self, spark):
        draw = random.Random(1)
        letters = "abé "
        passage = "".join(draw.choice("abcdefgh ") for _ in range(400))
        rows = [(1, None), (2, ""), (3, "z" * 49), (4, "z" * 500), (5, "z" * 51), (6, passage), (6, passage), (7, passage[:60]), (8, passage[5:54])]
        for i in range(9, 60):
            parts = []
            for _ in range(draw.randint(1, 6)):
                a = draw.randint(0, 350)
                parts += [passage[a : a + draw.randint(20, 120)], "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))]
            rows.append((i, "".join(parts)))
        draw.shuffle(rows)
        assert self.found(documents(spark, rows)) == self.brute(rows)

    def test_one_symbol_and_long_text(self, spark):
        draw = random.Random(2)
        long = "".join(draw.choice("abcd") for _ in range(300_000))
        rows = [(2, long), (1, long[1000:1100]), (3, "x" + long[200_000:200_050] + "y"), (4, "\0" * 200), (5, "\0" * 70)]
        assert self.found(documents(spark, rows)) == self.brute(rows)

    def test_rows_in_any_order_give_the_same_runs(self):
        import pyarrow as pa

        draw = random.Random(6)
        rows = [(i, "".join(draw.choice("abcdef ") for _ in range(30_000)).encode()) for i in range(50)]
        blocks = []
        for order in (rows, rows[::-1], draw.sample(rows, len(rows))):
            blocks.append(suffix_dedup.Block(pa.table({"doc_id": [i for i, _ in order], "text": pa.array([t for _, t in order], pa.binary())})))
        for block in blocks[1:]:
            assert (block.hash == blocks[0].hash).all() and (block.whole == blocks[0].whole).all()

    def test_given_table(self, spark):
        docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(tuple(r) for r in suffix_dedup.op1_suffix_dedup(spark, FOLDER).collect()) == self.brute(rows)

    def test_empty_table_and_null_id(self, spark):
        assert self.found(documents(spark, [])) == []
        assert self.found(documents(spark, [(None, "a" * 80)])) == []


class TestLines:
    def brute(self, rows):
        lines = [(i, p, frozenset(x.split())) for i, t in rows if i is not None for p, x in enumerate((t or "").split("\n")) if x.split()]
        lines.sort(key=lambda x: x[:2])
        return {(i, p) for k, (i, p, s) in enumerate(lines) for _, _, o in lines[:k] if 10 * len(s & o) >= 8 * len(s | o)}

    def test_against_brute_force(self, spark):
        draw = random.Random(3)
        base = [[draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randint(0, 9)) for _ in range(draw.randint(1, 25))] for _ in range(30)]
        rows = [(None, "a b c"), (0, None), (1, ""), (2, " \n\n a"), (3, "a\na\nb"), (4, "A a")]
        for i in range(5, 60):
            lines = []
            for _ in range(draw.randint(1, 8)):
                words = list(draw.choice(base))
                for _ in range(draw.randint(0, 3)):
                    words[draw.randrange(len(words))] = draw.choice(["q", "r9", "s"])
                lines.append(" ".join(words) + draw.choice(["", " ", "\t", "\r"]))
            rows.append((i, "\n".join(lines)))
        found = line_dedup.matches(documents(spark, rows)).collect()
        assert {(r.doc_id, r.place) for r in found} == self.brute(rows)
        assert len(found) == len(self.brute(rows))

    @pytest.mark.parametrize("seed", [1, 2])
    def test_long_lines_and_many_rare_words_against_brute_force(self, spark, seed):
        draw = random.Random(seed)
        word = lambda: f"w{int(draw.paretovariate(0.4)) % 5000}"
        base = [[word() for _ in range(draw.choice([3, 30, 60, 150, 400]))] for _ in range(25)]
        rows = []
        for i in range(70):
            lines = []
            for _ in range(draw.randint(1, 5)):
                words = list(draw.choice(base)) if draw.random() < 0.8 else [word() for _ in range(draw.randint(1, 80))]
                for _ in range(int(len(words) * draw.choice([0, 0.02, 0.08, 0.11, 0.15]))):
                    words[draw.randrange(len(words))] = word()
                lines.append(draw.choice([" ", "  ", "\t", "\x0b "]).join(words))
            rows.append((i, "\n".join(lines)))
        found = line_dedup.matches(documents(spark, rows)).collect()
        assert {(r.doc_id, r.place) for r in found} == self.brute(rows)
        assert len(found) == len(self.brute(rows))
        sets = {(i, p): set(x.split()) for i, t in rows for p, x in enumerate(t.split("\n"))}
        for r in found:
            a, b = sets[r.doc_id, r.place], sets[r.other_doc, r.other_place]
            assert (r.other_doc, r.other_place) < (r.doc_id, r.place) and 10 * len(a & b) >= 8 * len(a | b)

    def test_only_lines_with_a_partner_are_fetched(self, spark):
        lines = line_dedup.lines_of(documents(spark, [(i, "a b\nc d\n\ne f") for i in range(500)]))
        ids = spark.createDataFrame([(7, 0), (7, 3), (499, 1)], "doc_id long, place int")
        found = {(r.doc_id, r.place): r.line for r in line_dedup._wanted(lines, ids).collect()}
        assert found[7, 0] == "a b" and found[7, 3] == "e f" and found[499, 1] == "c d" and len(found) < 10

    def test_maps_tell_long_lines_apart(self, spark):
        texts = [" ".join([f"c{k}" for k in range(70)] + [f"o{i}x{k}" for k in range(70)]) for i in range(12)]
        sets = line_dedup._sets(line_dedup.lines_of(documents(spark, list(enumerate(texts)))), 80)
        other = sets.select(*[F.col(c).alias(f"other_{c}") for c in ("doc_id", "place", "n", *line_dedup._MAP)]).withColumnsRenamed({"other_doc_id": "other_doc", "other_n": "m"})
        assert sets.crossJoin(other).where(line_dedup._possible(80)[0]).count() == 0

    def test_texts(self, spark):
        rows = [(1, "one two three\nfour five"), (2, "x\none two three\ny z"), (3, "one two three"), (4, None), (5, ""), (None, "one two three")]
        docs = documents(spark, rows)
        kept = line_dedup.drop_repeated_lines(docs)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or 9, r.text) for r in kept.collect() if r.text is not None) == [(1, rows[0][1]), (2, "x\ny z"), (3, ""), (5, ""), (9, "one two three")]
        assert kept.where("text is null").count() == 1
        assert line_dedup.drop_repeated_lines(documents(spark, [])).count() == 0


class TestNearDuplicates:
    def test_components_against_brute_force(self, spark):
        draw = random.Random(4)
        fps = [draw.getrandbits(64) for _ in range(200)]
        for _ in range(600):
            fp = draw.choice(fps)
            for _ in range(draw.randint(1, 3)):
                fp ^= 1 << draw.randrange(64)
            fps.append(fp)
        fps = np.unique(np.array(fps, dtype=np.uint64))
        distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
        for most in (simhash.MAX_LIST, 25):  # the second cuts lists into blocks
            kept, simhash.MAX_LIST = simhash.MAX_LIST, most
            try:
                roots = {r.node: r.root for r in connected_components(simhash.links(distinct)).collect()}
            finally:
                simhash.MAX_LIST = kept
            label = np.arange(len(fps))
            for _ in range(len(fps)):
                near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
                new = np.where(near, label[None, :], len(fps)).min(axis=1)
                if (new == label).all():
                    break
                label = new
            mine = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
            assert len(set(zip(mine, label.tolist()))) == len(set(mine)) == len(set(label.tolist()))

    def test_fingerprint(self):
        import xxhash

        assert simhash.fingerprint_of(None) == simhash.fingerprint_of(" \n") == 0
        assert simhash.fingerprint_of("One  TWO") == xxhash.xxh64_intdigest(b"one two", 42)
        words = "a b c d e a b c d".split()
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(6)]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint_of(" ".join(words)) == bits

    def test_messy_rows(self, spark):
        rows = [(3, None), (2, ""), (5, "a b c d e"), (4, "A b c d e"), (4, "A b c d e"), (None, "a b c d e"), (9, "other words stand here")]
        docs = documents(spark, rows)
        found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs.where("doc_id is not null")).collect()}
        assert found == {(3, 2), (2, 2), (5, 4), (4, 4), (9, 9)}
        assert sorted(r.doc_id or 0 for r in simhash.drop_near_duplicates(docs).collect()) == [0, 2, 4, 4, 9]
        assert simhash.near_duplicates(documents(spark, [])).count() == 0


class TestNearCopies:
    """The near-duplicate stage: links are Jaccard similarities of five-word shingles of at least 0.8."""

    def brute(self, rows):
        sets = {}
        for i, t in rows:
            words = (t or "").lower().split()
            sets.setdefault(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset(), set()).add(i)
        keys = sorted(sets, key=lambda s: min(sets[s]))
        root = {s: s for s in keys}

        def find(s):
            while root[s] is not s:
                s = root[s]
            return s

        for k, s in enumerate(keys):
            for o in keys[:k]:
                if 5 * len(s & o) >= 4 * len(s | o):
                    root[max(find(s), find(o), key=lambda x: min(sets[x]))] = min(find(s), find(o), key=lambda x: min(sets[x]))
        return {(i, min(sets[find(s)])) for s in keys for i in sets[s]}

    def found(self, docs):
        return {(r.doc_id, r.component_id) for r in near_copies.near_copies(docs).collect()}

    def test_against_brute_force(self, spark, monkeypatch):
        draw = random.Random(8)
        base = [[f"w{draw.randint(0, 5000)}" for _ in range(draw.randint(1, 300))] for _ in range(12)]
        passage = [f"p{k}" for k in range(60)]
        rows = [(1, None), (2, " "), (3, "one two"), (4, "ONE two"), (5, "one two three")]
        for i in range(6, 160):
            words = list(draw.choice(base))
            for _ in range(draw.choice([0, 1, 2, 4, 6])):
                words[draw.randrange(len(words))] = f"x{draw.randint(0, 9)}"
            rows.append((i, " ".join(words + (passage if draw.random() < 0.3 else []))))
        draw.shuffle(rows)
        docs = documents(spark, rows)
        assert len({c for _, c in self.brute(rows)}) < len(rows) - 20
        assert self.found(docs) == self.brute(rows)
        monkeypatch.setattr(near_copies, "MAX_LIST", 7)
        monkeypatch.setattr(near_copies, "_FREQUENT", 3)
        assert self.found(docs) == self.brute(rows)
        assert near_copies.near_copies(documents(spark, [])).count() == 0

    @pytest.mark.skipif(find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
    def test_the_stage_removes_what_four_bits_miss_and_keeps_what_is_below(self, spark):
        import corpus_pipeline

        words = [f"w{k}" for k in range(100)]
        edited = [w + "x" if k in (30, 70) else w for k, w in enumerate(words)]  # 86 of 106 shingles shared: 0.81
        further = [w + "y" if k in (20, 45, 80) else w for k, w in enumerate(words)]  # 81 of 111: 0.73
        rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(further))]
        assert (simhash.fingerprint_of(rows[0][1]) ^ simhash.fingerprint_of(rows[1][1])).bit_count() > 4
        kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), FOLDER)
        assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


    @pytest.mark.skipif(find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
    def test_the_stage_links_fingerprints_first(self, spark, monkeypatch):
        import corpus_pipeline

        draw, links, checked = random.Random(3), simhash.links, []
        base = [f"w{draw.randint(0, 9000)}" for _ in range(400)]
        rows = [(1, None), (2, " "), (3, "one two")]
        for i in range(4, 40):
            words = list(base) if i % 2 else [f"v{draw.randint(0, 9000)}" for _ in range(50)]
            words[draw.randrange(50)] = f"x{i}"
            rows.append((i, " ".join(words)))
        fps = [simhash.fingerprint_of(t, near_copies.SHINGLE) for _, t in rows]
        assert any(0 < (x ^ y).bit_count() <= 4 for x in fps for y in fps)

        def spied(distinct, max_bits):
            checked.append((max_bits, sorted(r.fp % 2**64 for r in distinct.collect())))
            return links(distinct, max_bits)

        monkeypatch.setattr(simhash, "links", spied)
        kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), FOLDER)
        assert {r.doc_id for r in kept.collect()} == {c for _, c in self.brute(rows)}
        assert checked == [(4, sorted(set(fps)))]


    def test_whole_sets_are_fetched_for_links_only_and_steps_are_removed(self, spark, monkeypatch):
        draw, staged = random.Random(9), []
        rows = []
        for i in range(80):  # all meet in lists of one passage
            words = [f"w{draw.randint(0, 10**6)}" for _ in range(150)]
            rows.append((i, " ".join([*words, *"a passage that many of them have".split()])))
        rows.append((80, rows[3][1].replace(rows[3][1].split()[70], "other")))
        kept = session.stage
        monkeypatch.setattr(session, "_GIVEN", {})

        def spied(df, label):
            result = kept(df, label)
            staged.append((label, result.count() if label == "sets" else 0))
            return result

        monkeypatch.setattr(near_copies, "stage", spied)
        monkeypatch.setattr(near_copies, "_FREQUENT", 10**6)
        found = self.found(documents(spark, rows))
        assert found == {(i, 3 if i == 80 else i) for i, _ in rows} == self.brute(rows)
        assert sum(n for _, n in staged) <= 4
        left = [path for paths in session._GIVEN.values() for path in paths]
        assert [os.path.basename(path).rpartition("-")[0] for path in left] == ["near-copies"]
        assert all(os.path.exists(path.removeprefix("file://")) for path in left)

    def test_filters_leave_out_no_link(self):
        draw = np.random.default_rng(4)
        for n in (1, 2, 7, 90, 1024, 1025, 3000):
            pool = np.unique(draw.integers(0, 2**64, 2 * n + 8, dtype=np.uint64))
            for gone, more in ((0, 1), (n // 20, n // 20), (n // 9, n // 9), (n // 6, 0), (0, n // 4), (n // 2, n // 2)):
                x, y = np.sort(pool[:n]), np.sort(np.r_[pool[gone:n], pool[n : n + more]])
                differing = len(np.setxor1d(x, y))
                maps = [np.frombuffer(near_copies._map(v), dtype=np.uint64) for v in (x, y)]
                for size in (min(map(len, maps)), near_copies.BRIEF // 64):
                    assert int(np.bitwise_count(np.bitwise_xor(*(near_copies._folded(m, size) for m in maps))).sum()) <= differing
                shared = np.intersect1d(x, y)
                if len(shared) * 5 >= 4 * (len(x) + len(y) - len(shared)):
                    assert differing <= len(x) + len(y) - 2 * near_copies._needed(len(x), len(y))
                    assert near_copies._may_link(len(x), np.searchsorted(x, shared[0]), len(y), np.searchsorted(y, shared[0]))


def test_scratch_keeps_what_it_is_told_to(spark, monkeypatch):
    monkeypatch.setattr(session, "_GIVEN", {})
    before = session.stage(spark.range(3), "before")
    with session.scratch(spark) as result:
        with session.scratch(spark) as keep:
            session.stage(spark.range(5), "inside")
            inner = keep(spark.range(7), "kept")
        session.stage(spark.range(9), "inside")
        assert inner.count() == 7
        outer = result(inner.where("id > 4"), "kept")
    assert (before.count(), outer.count()) == (3, 2)
    (paths,) = session._GIVEN.values()
    assert [os.path.basename(path).rpartition("-")[0] for path in paths] == ["before", "kept"]
    assert session.remove_staged(spark) == 2


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(1000, 1200)} == {1000} and 7 not in found


@pytest.mark.skipif(find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline_sends_few_rows_at_once_to_python(spark):
    import corpus_pipeline

    key, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.read.parquet(f"{FOLDER}/documents.parquet")
    try:
        for given, expected in ((None, "1000"), ("77", "77")):
            spark.conf.unset(key) if given is None else spark.conf.set(key, given)
            corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
            assert spark.conf.get(key) == expected
    finally:
        spark.conf.unset(key)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, FOLDER)
        rows = out.collect()
        assert {r.doc_id for r in rows} <= set(before) and len(rows) == len({r.doc_id for r in rows}), name
        if name == "bpe":
            assert len(rows) == len(before) and all(r.n_tokens == len(r.ids) for r in rows)
            return
        assert out.columns == columns
        if name == "line_dedup":
            gone = TestLines().brute(list(before.items()))
            expected = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in before.items()}
            assert {r.doc_id: r.text for r in rows} == expected
        if name == "simhash":
            fps = {i: simhash.fingerprint_of(t) for i, t in before.items()}
            assert {r.doc_id for r in rows} >= {i for i in fps if all(j >= i or (fps[i] ^ fps[j]).bit_count() > 4 for j in fps)}
        before = {r.doc_id: r.text for r in rows}
        docs = spark.createDataFrame(rows, out.schema)
