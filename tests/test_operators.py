"""Operators on small hand-made tables, plans, and comparisons with brute force."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlake.functions import geometry as GM
from emberlake.functions import parsing as PA
from emberlake.functions.quantiles import grouped_quantiles
from emberlake.operators import clean, combine, filters, incremental, learning, limits, nested, patterns, points, profile, questions, vector
from emberlake.operators import geo, project
from emberlake.plans import certificates, meters, vehicles
from emberlake.plans import schema_search as schema_search_module
from emberlake.plans.schema_search import schema_search
from emberlake.sources import readers, writers
from emberlake.spec import CONNECTIONS, TECH_DETAILS, TableSpec, table_spec
from tests.conftest import plan_of

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- quantiles ---------------------------------------------------------------------------------------

def test_quantiles_match_pandas_with_a_hot_group_and_ties(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({
        "g": rng.choice(["hot", "warm", "cold"], 30_000, p=[0.7, 0.29, 0.01]),
        "x": rng.normal(size=30_000), "y": rng.integers(0, 4, 30_000).astype(float),
    })
    pdf.loc[rng.random(30_000) < 0.1, "x"] = None
    probs = [0.25, 0.5, 0.75]
    got = grouped_quantiles(spark.createDataFrame(pdf), ["g"], ["x", "y"], probs, accuracy=10, max_candidates=900).collect()
    assert len(got) == 6
    for r in got:
        want = pdf[pdf.g == r.g][r.measure].dropna()
        assert r.n == len(want)
        assert r.q == pytest.approx(list(want.quantile(probs)), abs=1e-12)
        assert r["std"] == pytest.approx(want.std())


def test_quantiles_of_tiny_groups_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 3.0), ("b", float("nan")), (None, 9.0), ("c", None)], "g string, x double")
    got = {r.g: r.q for r in grouped_quantiles(df, ["g"], ["x"], [0.25]).collect()}
    assert got == {"a": [1.75], "b": [3.0]}


# --- parsing and cleaning ----------------------------------------------------------------------------

@pytest.mark.parametrize("text, number", [
    ("75 kWh", 75.0), ("85%", 0.85), ("60-80 kWh", 70.0), ("60 to 80", 70.0), ("N/A", None), ("Unknown", None), ("TBD", None),
    ("", None), ("-5", -5.0), ("1e-5", 0.00001), ("1.2.3", None), (" 12\n", 12.0), ("word", None), (None, None), ("7.5 l/100k", 7.5),
])
def test_smart_number(spark, text, number):
    got = spark.createDataFrame([(text,)], "t string").select(PA.smart_number(F.col("t"))).first()[0]
    assert got == number if number is None else got == pytest.approx(number)


@pytest.mark.parametrize("text, number", [("64.5...", 64.5), ("1.2.3", 1.2), ("95 Wh", 95.0), ("nan", None), ("60-80", 70.0), ("inf", None)])
def test_capacity_number(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(PA.capacity_number(F.col("t"))).first()[0] == number


@pytest.mark.parametrize("text, day", [
    ("2024-03-05", "2024-03-05 00:00:00"), ("03/05/2024", "2024-03-05 00:00:00"), ("05-03-2024", "2024-03-05 00:00:00"),
    ("2024-03-05T10:20:30", "2024-03-05 10:20:30"), ("2024-13-45", None), ("soon", None),
])
def test_parsed_timestamp(spark, text, day):
    df = spark.createDataFrame([(text,)], "t string").select(PA.parsed_timestamp(F.col("t")).cast("string"))
    assert df.first()[0] == day


def test_cleaning_plan_needs_content_and_loose_rule_does_not(spark):
    df = spark.createDataFrame(
        [("Active", "5 km", "2024-01-01", "free text", "1700000000"), ("Inactive", "7 km", "2024-01-02", "more text", "1700000001")],
        "row_status string, distance string, day string, note string, created_time string",
    )
    assert clean.cleaning_plan(df) == {
        "row_status": "boolean", "distance": "number", "day": "timestamp", "note": "keep", "created_time": "epoch",
    }
    assert clean.cleaning_plan(df, strict=False)["row_status"] == "number"
    cleaned = clean.auto_clean(df).orderBy("distance").collect()
    assert [r.row_status for r in cleaned] == [True, False]
    assert [r.distance for r in cleaned] == [5.0, 7.0]


def test_profile_statistics_match_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.exponential(size=500), "b": rng.normal(size=500)})
    df = spark.createDataFrame(pdf)
    for r in profile.distribution_shape(df, digits=8).collect():
        assert r.skewness == pytest.approx(pdf[r["column"]].skew(), abs=1e-6)
        assert r.kurtosis == pytest.approx(pdf[r["column"]].kurtosis(), abs=1e-6)
    for r in profile.describe_numeric(df).collect():
        want = pdf[r["column"]].describe()
        assert [r["mean"], r["std"], r["q25"], r["q50"], r["q75"]] == pytest.approx([want[k] for k in ("mean", "std", "25%", "50%", "75%")])


# --- questions ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("text, intent, confidence", [
    ("find connections by EMSN 24E8049370", "find_by_emsn", 0.9), ("search connections in SE23 area", "location_search", 0.9),
    ("check xoserveMeters API status", "api_status_check", 0.9), ("find connections on WESTBOURNE DRIVE", "address_search", 0.8),
    ("hello there", "general_search", 0.0), ("uprn is maybe 10023229787", "find_by_uprn", 0.9),
])
def test_intents(spark, text, intent, confidence):
    r = questions.analyse(spark.createDataFrame([(text,)], "question string"), CONNECTIONS).first()
    assert (r.intent, r.confidence) == (intent, confidence)


def test_pattern_match_scenarios(spark):
    asked = {
        "What are the most common errors in MPAN records?": "find_errors", "Analyze error patterns in MPAN data": "analyze_patterns",
        "zzz": None,
    }
    df = spark.createDataFrame([(q,) for q in asked], "question string")
    got = {r.question: r.match.answer_intent if r.match else None for r in patterns.match_patterns(df, TECH_DETAILS).collect()}
    assert got == asked


def test_keywords_keep_order_and_repeats(spark):
    df = spark.createDataFrame([("Show the Élan of energy, energy in UK",)], "q string")
    assert df.select(questions.keywords(F.col("q"))).first()[0] == ["show", "élan", "energy", "energy"]


def brute_force_search(asked, documents, limit=20):
    """The search rules applied pair by pair in plain Python, for a handful of rows."""
    found = {}
    for q in asked:
        hits = []
        for d in sorted(documents, key=lambda d: d["_id"]):
            ok = all(e.value in d[e.field] for e in q.exact)
            ok &= not q.postcodes or any(p.upper().startswith(z) for p in d["POSTCODE"] for z in q.postcodes)
            ok &= q.street is None or any(q.street in a.upper() for a in d["ADDRESS"])
            if not q.exact and not q.postcodes and q.street is None and q.number:
                ok = q.number in d["UPRN"]
            hits += [d["_id"]] if ok else []
        found[q.question_id] = hits[:limit]
    return found


def test_schema_search_matches_brute_force_with_a_hot_area(spark):
    documents = [
        {"_id": i, "UPRN": [str(1000 + i)], "EMSN": [f"E{i}"], "MPAN": [], "MPRN": [],
         "POSTCODE": ["SE23 2UN" if i % 3 else f"N{i % 9} 1AA"], "ADDRESS": ["FLAT, WESTBOURNE DRIVE" if i % 2 else "OAK ROAD"]}
        for i in range(60)
    ]
    texts = [
        "EMSN E7", "connections in SE23 area", "find N3 1AA", "on BOURNE drive", "SE23 near BOURNE drive", "oak road in n6",
        "number 1005", "anything", "EMSN E1 in SE23", "EMSN E3 in SE23", "SE23 or N3",
    ]
    kind = "_id long, UPRN array<string>, EMSN array<string>, MPAN array<string>, MPRN array<string>, POSTCODE array<string>, ADDRESS array<string>"
    docs = spark.createDataFrame([tuple(d.values()) for d in documents], kind)
    asked = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")
    got = {}
    for r in schema_search(asked, docs, CONNECTIONS).collect():
        got.setdefault(r.question_id, []).append(r.doc)
    want = brute_force_search(questions.analyse(asked, CONNECTIONS).collect(), documents)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


# --- vectors -----------------------------------------------------------------------------------------

def test_nearest_matches_brute_force_with_many_copies(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(3000, 8)).astype(np.float32)
    m[::3] = m[0]  # a third of all rows are copies of one vector
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>").repartition(5)
    q = m[1].astype(float)
    d = m.astype(float)
    scores = np.round(d @ q / (np.linalg.norm(d, axis=1) * np.linalg.norm(q) + 1e-8), 9)
    want = np.lexsort((np.arange(3000), -scores))[:25]
    assert [r.id for r in vector.nearest(df, q, 25, id_column="id").orderBy(F.desc("score"), "id").collect()] == list(want)
    copies = vector.nearest(df, d[0], 25, id_column="id").orderBy("id").collect()
    assert [r.id for r in copies] == list(range(0, 75, 3))


def test_many_queries_agree_in_one_wave_and_in_several(spark):
    v = readers.table(spark, SF, "embeddings")
    a = vector.nearest_many(v, v, 4, id_column="vec_id", query_id="vec_id")
    b = vector.nearest_many(v, v, 4, id_column="vec_id", query_id="vec_id", wave_numbers=64 * 100)
    assert rows(a, "query_id", "rank") == rows(b, "query_id", "rank")


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_many_queries_refuse_vectors_of_another_size_at_every_size(spark, most):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 2.0, 3.0]), (3, None)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "q long, embedding array<double>")
    with pytest.raises(Exception, match="vectors of size 3 among those of size 2"):
        vector.nearest_many(df, asked, 2, id_column="id", query_id="q", wave_numbers=most).collect()


def test_vectors_of_two_sizes_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<double>")
    with pytest.raises(ValueError):
        vector.vector_size(df)


def test_encoder_model_is_loaded_per_task(spark):
    df = spark.createDataFrame([("abc",), (None,), ("de",)], "text string")
    out = vector.embed_with(df, "text", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert sorted(r.embedding[0] for r in out.collect()) == [0.0, 2.0, 3.0]


# --- tables, joins, sinks ----------------------------------------------------------------------------

def test_upsert_keeps_the_newest_and_is_repeatable(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, version int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, version int")
    once = points.upsert(old, new, "id", [F.desc("version")])
    assert rows(once, "id") == [(1, "a", 0), (2, "d", 2), (3, "e", 1)]
    assert rows(points.upsert(once, new, "id", [F.desc("version")]), "id") == rows(once, "id")


def test_tagged_union_and_missing_relation(spark):
    a = spark.createDataFrame([(1, "x")], "k long, n string")
    b = spark.createDataFrame([(2, "y")], "k long, n string")
    out = combine.combine_tables({"a": a, "b": b}, [combine.Relationship("a", "b", ("absent",), ("k",))])
    assert sorted(out.columns) == ["_source_table", "k_a", "k_b", "n_a", "n_b"]
    assert out.count() == 2


def test_link_join_counts_with_repeated_links(spark):
    main = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    link = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "upn long, uprn string")
    r = combine.link_join_counts(main, link, "id", "upn").first()
    assert (r.total_rows, r.matched, r.unmatched, r.joined_rows) == (3, 1, 2, 4)
    assert combine.link_join(main, link, "id", "upn").count() == 4


def test_readers_refuse_unreadable_formats(spark):
    with pytest.raises(ValueError):
        readers.read_any(spark, "sheet.xlsx")
    with pytest.raises(ValueError):
        readers.read_any(spark, "data.feather")


def test_copy_is_verified(spark, tmp_path):
    df = readers.table(spark, SF, "documents").select("doc_id", "lang")
    assert writers.copy_collections(df, str(tmp_path / "copy"), column="lang")


def test_date_filter_metadata():
    assert table_spec("epc_non_domestic_scotland").date_column == "LODGEMENT_DATE"
    assert table_spec("epc_domestic_scotland").date_column == "lodgement_date"
    assert [table_spec(n).date_column for n in ("bev", "phev", "unknown")] == [None, None, None]


def test_declared_types_ignore_absent_columns(spark):
    df = spark.createDataFrame([("1.5", "x"), ("bad", "y")], "FLOOR_AREA string, other string")
    out = project.coerce_declared(df, table_spec("epc_non_domestic_scotland"))
    assert [r.FLOOR_AREA for r in out.collect()] == [1.5, None]


def test_context_is_cut_and_sampled(spark):
    df = spark.range(30).select(F.lit("error").alias("type"), F.col("id").cast("string").alias("value"), F.lit("r" * 80).alias("Results"), F.lit(1).alias("extra_col"))
    out = limits.optimised_context(df, TECH_DETAILS, ["value"])
    assert out.columns == ["type", "value"] and out.count() == 10


def test_vehicle_reports(spark):
    data = [("car-a", 61.5), ("car-b", 30.0), ("car-c", 58.0), ("car-d", 51.0), ("car-e", 44.5), ("car-f", None)]
    df = spark.createDataFrame(data, "Vehicle_ID string, full double")
    assert vehicles.best_row(df, "full", "Vehicle_ID").first().Vehicle_ID == "car-a"
    assert [r.Vehicle_ID for r in vehicles.top_rows(df, "full", "Vehicle_ID").collect()] == ["car-a", "car-c", "car-d", "car-e", "car-b"]
    assert vehicles.spread(df, "full").first()["median"] == 51.0


def test_meter_coverage_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 1, 2024), (1, 1, 2024), (1, 2, 2024), (2, 1, 2024)], "meterNo long, month int, year int")
    assert rows(meters.coverage(df, 2), "meterNo") == [(1, 2, 0, 100.0), (2, 1, 1, 50.0)]
    assert meters.missing_columns(df) == ["fuelType", "consumption", "readingType"]


def test_monthly_changes_leave_out_null_dates(spark):
    df = spark.createDataFrame([("2024-01-05", 1.0), ("2024-01-09", 2.0), (None, 5.0)], "d string, x double").withColumn("d", F.col("d").cast("date"))
    r = certificates.monthly_changes(df, "d", {"x": "x"}).collect()
    assert len(r) == 1 and (r[0].total_certificates, r[0].avg_x, r[0].median_x, str(r[0].date)) == (2, 1.5, 1.5, "2024-01-01")


def test_unpack_everything(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', 'x') AS s, map('p', 1) AS m, array('u', 'v') AS l, '{\"k\": {\"z\": 1}}' AS j")
    r = nested.unpack(df).first()
    assert (r.s_a, r.s_b, r.m_p, r.l_joined, r.j_k.z) == (1, "x", 1, "u | v", 1)


def test_used_ids_across_runs(spark):
    df = incremental.with_id(spark.createDataFrame([("q1", "a1"), ("q2", "a2")], "question string, answer string"))
    tracker = incremental.tracker_rows(df.where("question = 'q1'"), "t", "qa")
    new = incremental.new_rows(df, tracker, "t", "qa")
    assert rows(incremental.training_pairs(new)) == [("q2", "a2", 1.0)]
    assert incremental.new_rows(df, tracker, "other", "qa").count() == 2


def test_evolution_needs_enough_rows(spark):
    p = spark.createDataFrame([("c", "i", 0.5, 0.5)], "collection_name string, answer_intent string, confidence_score double, success_rate double").withColumn("updated_at", F.lit(None).cast("timestamp"))
    def rated(n):
        return spark.range(n).select(F.lit("c").alias("collection_name"), F.lit("i").alias("detected_intent"), F.lit(4).alias("user_satisfaction"))
    now = F.lit("2024-01-01").cast("timestamp")
    assert learning.evolve_patterns(p, rated(9), now).first().confidence_score == 0.5
    r = learning.evolve_patterns(p, rated(10), now).first()
    assert (r.confidence_score, r.success_rate) == (0.8, 1.0)


def test_keyword_filter_treats_keywords_as_text(spark):
    df = spark.createDataFrame([("a.b", 1), ("axb", 2), (None, 3)], "t string, n int")
    assert [r.n for r in filters.matching_keywords(df, ["A.B"]).collect()] == [1]
    assert filters.matching_keywords(df, []).count() == 3


# --- geometry ----------------------------------------------------------------------------------------

def test_grid_reference_point():
    lon, lat = GM.grid_to_wgs84(np.array([651409.903]), np.array([313177.270]))
    # Published worked example, 52.6576 N 1.7179 E on the old datum; about 100 m apart on WGS84.
    assert lat[0] == pytest.approx(52.6580, abs=2e-4) and lon[0] == pytest.approx(1.7160, abs=3e-4)


def test_geometries_of_a_batch_are_projected_together(monkeypatch):
    def headed(x, y, n):
        ring = np.array([[x + i, y + i * i] for i in range(n)], dtype="<f8")
        return bytes(40) + struct.pack("<BII", 1, 2, n) + ring.tobytes()

    plain = struct.pack("<BIdd", 1, 1, -3.5, 55.0)
    rows = [v for i in range(200) for v in (headed(200000.0 + 900 * i, 100000.0 + 700 * i, 2 + i % 5), plain, b"bad", None)]
    alone = [GM.decode(r) for r in rows]
    project, sizes = GM.grid_to_wgs84, []

    def counted(east, north):
        sizes.append(len(east))
        return project(east, north)

    monkeypatch.setattr(GM, "grid_to_wgs84", counted)
    monkeypatch.setattr(GM, "POINTS_AT_ONCE", 500, raising=False)
    got = geo._decoded.func(pd.Series(rows))
    assert sizes == [500, 300]
    for found, wkt, low in zip(alone, got["wkt"], got["min_x"]):
        assert (wkt is None) == (found is None)
        if found:
            assert wkt == GM.to_wkt(*found) and low == min(r[:, 0].min() for part in found[1] for r in part)


def test_geometry_forms(spark):
    point = struct.pack("<BIdd", 1, 1, -0.1, 51.5)
    big = struct.pack(">BIdd", 0, 1, -0.1, 51.5)
    custom = struct.pack("<BIdd", 1, 80, -0.2, 51.6)
    headed = b"\0" * 40 + struct.pack("<BIII", 1, 3, 1, 4) + np.array([[530000, 180000], [530100, 180000], [530100, 180100], [530000, 180000]], "<f8").tobytes()
    hexed = b"0x" + point.hex().encode()
    data = [(i, bytearray(b) if b is not None else None) for i, b in enumerate([point, big, custom, headed, hexed, b"junk", None])]
    df = spark.createDataFrame(data, "id long, geom binary")
    got = geo.with_validity(geo.with_geometry(df)).orderBy("id").collect()
    assert [r.wkt for r in got[:3]] == ["POINT (-0.1 51.5)", "POINT (-0.1 51.5)", "POINT (-0.2 51.6)"]
    assert got[3].wkt.startswith("POLYGON ((-0.1") and -0.2 < got[3].min_x < 0 and 51 < got[3].min_y < 52
    assert got[4].wkt == "POINT (-0.1 51.5)"
    assert [r.wkt for r in got[5:]] == [None, None] and [r.is_valid for r in got] == [True] * 5 + [False] * 2


def test_index_build_shares_a_one_file_collection(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(schema_search_module, "build_index", lambda keys, count, path: seen.append((keys, count)))
    docs = spark.createDataFrame([(i, [f"u{i}"], [f"AB{i} 1CD"], None) for i in range(50)] + [(None, None, None, None)], "_id long, UPRN array<string>, POSTCODE array<string>, other string")
    schema_search_module.collection_index(docs.coalesce(1), CONNECTIONS)
    (keys, count), = seen
    assert count == 51 and keys.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(keys.where("kind = 'UPRN'").collect()) == sorted(("UPRN", f"u{i}", i) for i in range(50))


# --- plans -------------------------------------------------------------------------------------------

def test_plans(spark):
    lines = readers.table(spark, SF, "lineitem")
    keys = lines.where("l_returnflag = 'R'").select("l_orderkey")
    assert "LeftSemi" in plan_of(filters.with_keys(lines, keys, ["l_orderkey"]))
    found = vector.nearest(readers.table(spark, SF, "embeddings"), [0.0] * 63 + [1.0], 5, id_column="vec_id")
    assert "TakeOrderedAndProject" in plan_of(found)
    report = plan_of(certificates.count_by(lines, "l_returnflag"))
    assert "ReadSchema: struct<l_returnflag:string>" in report and "Python" not in report
    ranked = plan_of(combine.newest_per_key(lines, ["l_suppkey"], [F.desc("l_shipdate")], 3))
    assert ranked.count("WindowGroupLimit") == 2
    spec = TableSpec("x", date_column="l_shipdate")
    assert "GreaterThanOrEqual(l_shipdate" in plan_of(filters.in_date_range(lines, spec, "1996-01-01", "1996-02-01"))
    for name in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert name not in plan_of(patterns.match_patterns(lines.select(F.col("l_returnflag").alias("question")), CONNECTIONS))


def test_text_search_score(spark):
    df = spark.createDataFrame([(1, "Ring ring, data."), (2, "ringing"), (3, "data")], "id long, text string")
    got = {r.id: r.score for r in vector.text_search(df, "text", "the ring data", id_column="id").collect()}
    assert got == {1: round(2 * math.log(4) + math.log(2.5), 6), 3: round(math.log(2.5), 6)}


def test_stored_index_gives_the_same_and_no_nested_loops(spark, tmp_path):
    from emberlake.plans import posting_index, schema_search as search
    from tests.conftest import plan_of

    documents = spark.range(300).select(
        F.col("id").alias("_id"), F.array(F.col("id").cast("string")).alias("UPRN"), F.array(F.concat(F.lit("E"), F.col("id") % 50)).alias("EMSN"), F.array().cast("array<string>").alias("MPAN"),
        F.lit(None).cast("array<string>").alias("MPRN"), F.array(F.lit("SE23 2UN")).alias("POSTCODE"), F.array(F.when(F.col("id") % 2 == 0, "OAK ROAD").otherwise("ELM DRIVE")).alias("ADDRESS"))
    asked = spark.createDataFrame([(1, "EMSN E7 in SE23"), (2, "EMSN E8 on oak road in SE23"), (3, "SE23"), (4, "EMSN E999 in SE23"), (5, "hello")], "question_id long, question string")
    index = posting_index.build_index(search.document_keys(documents, "_id", CONNECTIONS), 300, str(tmp_path / "index"), docs_per_block=40)
    assert index.postings.select(F.max(F.size("docs"))).first()[0] < 80  # SE23 is carried by all 300
    assert index.terms.where("kind = 'POSTCODE' and term = 'SE23'").first()["n"] == 300
    index = posting_index.load_index(spark, str(tmp_path / "index"))
    found = search.schema_search(asked, documents, CONNECTIONS, index=index)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    got = {}
    for r in found.collect():
        got.setdefault(r.question_id, []).append(r.doc)
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [7, 57, 107, 157, 207, 257], 2: [8, 58, 108, 158, 208, 258], 3: list(range(20)), 5: list(range(20))}


def test_index_of_an_empty_collection(spark):
    from emberlake.plans import posting_index

    keys = spark.createDataFrame([], "kind string, term string, doc string")
    index = posting_index.build_index(keys, 0)
    lookups = spark.createDataFrame([("s", 1, "A", "A", "x")], "search string, criteria int, criterion string, kind string, term string")
    assert posting_index.search_index(index, lookups, 5).count() == 0


def test_null_query_vectors_have_no_hits_and_rows_without_vectors_are_no_hits(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, embedding array<double>")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "q string, embedding array<double>")
    found = vector.nearest_many(df, asked, 5, id_column="id", query_id="q").collect()
    assert [(r.query_id, r.id, r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [("a", 1, 1), ("a", 2, 2)]
    nobody = vector.nearest_many(df, asked.where("q = 'b'"), 5, id_column="id", query_id="q")
    assert nobody.columns == ["query_id", "id", "score", "rank"] and nobody.count() == 0


def test_fall_back_stages_run_only_for_what_is_left(spark):
    seen = []

    def search(name, ids):
        def run(left):
            seen.append((name, sorted(r.q for r in left.collect())))
            return left.where(F.col("q").isin(ids)).select("q", F.lit(name).alias("hit"))

        return run

    asked = spark.range(4).select(F.col("id").alias("q"))
    found = vector.first_nonempty_stage({"a": search("a", [0, 1]), "b": search("b", [1, 2, 3]), "c": search("c", [0, 1, 2, 3])}, asked, "q")
    assert sorted((r.q, r.source) for r in found.collect()) == [(0, "a"), (1, "a"), (2, "b"), (3, "b")]
    assert seen == [("a", [0, 1, 2, 3]), ("b", [2, 3])]
    fail = lambda _: 1 / 0
    assert vector.first_nonempty_stage({"a": lambda _: asked, "b": fail}).count() == 4


def test_too_many_map_keys_are_an_error(spark):
    from emberlake.operators import nested

    rows = spark.range(20).select(F.create_map(F.col("id").cast("string"), F.lit(1)).alias("m"))
    assert len(nested.map_keys_of(rows, "m", most=20)) == 20
    with pytest.raises(ValueError, match="more than 19 keys"):
        nested.map_keys_of(rows, "m", most=19)


def test_columns_of_connections_are_those_of_the_pattern(spark):
    asked = spark.createDataFrame([("show me string or integer things",), ("show me connection for EMSN 24E8049370",)], "question string")
    found = [[c["name"] for c in r.relevant_columns] for r in patterns.enhance(asked, CONNECTIONS).collect()]
    assert found == [[], ["EMSN", "ADDRESS", "POSTCODE", "UPRN", "apiStatus"]]
    with pytest.raises(TypeError):
        type(CONNECTIONS.dictionary[0])("UPRN", "text", "string")


def test_contained_pairs_equal_all_pairs(spark):
    import random

    from emberlake.operators.containment import contained_pairs

    draw = random.Random(2)
    word = lambda low, high: "".join(draw.choice("abé🎉") for _ in range(draw.randint(low, high)))
    parts, wholes = [word(0, 5) for _ in range(60)] + [None], [word(0, 30) for _ in range(80)] + [None, "a", "ab"]
    found = contained_pairs(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in wholes], "whole string"))
    want = {(p, w) for p in parts for w in wholes if p and w is not None and p in w}
    got = [(r.part, r.whole) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.92])
def test_stored_patterns_equal_scoring_all(spark, threshold):
    import random

    draw = random.Random(4)
    words = ["mpan", "error", "meter", "postcode", "xx", "q", "supplier", "é"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(draw.randint(1, n)))
    stored = [(text(3), f"intent{i % 7}", [text(4) for _ in range(i % 3)], [draw.choice(words).upper() for _ in range(i % 4)], [f"c{i}"], "s", round(draw.random(), 1)) for i in range(40)]
    stored += [(None, "none", [], [], [], "s", 1.0), stored[0]]
    kind = "question_pattern string, answer_intent string, samples array<string>, entities array<string>, expected_columns array<string>, search_strategy string, confidence_score double"
    asked = [text(7).title() for _ in range(60)] + ["", None, "Mpan", "nothing known"]
    spec = type(TECH_DETAILS)("own", intent_keywords={"a": ("mpan", "error"), "b": ("supplier", "zz")})
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i long, question string")
    found = {r.i: r.match for r in patterns.match_patterns(df, spec, stored=spark.createDataFrame(stored, kind), threshold=threshold).collect()}
    assert len(found) == len(asked)
    for i, q in enumerate(asked):
        low = None if q is None else q.lower()
        options = []
        for p, intent, samples, entities, columns, strategy, confidence in [s for s in stored if s[0]] if q is not None else []:
            share = sum(w.lower() in low for w in ("mpan", "error", "supplier", "zz")) / 4.0
            part = sum(e.lower() in low for e in entities) / len(entities) if entities else 0.0
            meets = lambda t: t.lower() in low or low in t.lower()
            score = 0.95 if meets(p) else 0.9 if any(map(meets, samples)) else min(part * 0.4 + share * 0.6, 0.85)
            if score >= threshold:
                options.append((-score, -confidence, p, intent, columns))
        best = min(options) if options else None
        got = found[i] and (-found[i].score, found[i].question_pattern, found[i].answer_intent, found[i].expected_columns)
        assert got == (best and (best[0], *best[2:])), q


def test_no_question_visits_all_stored_patterns(spark):
    stored = spark.range(50).select(F.concat(F.lit("pattern "), "id").alias("question_pattern"), F.lit("i").alias("answer_intent"), F.array().cast("array<string>").alias("samples"),
        F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("expected_columns"), F.lit("s").alias("search_strategy"), F.lit(1.0).alias("confidence_score"))
    asked = spark.range(50).select(F.concat(F.lit("show pattern "), "id").alias("question"))
    plan = plan_of(patterns.match_patterns(asked, type(TECH_DETAILS)("own"), stored=stored))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_staged_folders_go_with_their_owner(spark, monkeypatch):
    import os

    from emberlake import session

    monkeypatch.setattr(session, "_GIVEN", {})
    staged = session.stage(spark.range(10), "numbers")
    folder = session._GIVEN[spark.sparkContext.applicationId][0].removeprefix("file:")
    assert staged.count() == 10 and os.path.isdir(folder)
    assert session.remove_staged(spark) == 1 and not os.path.exists(folder)
    assert session.remove_staged(spark) == 0


def test_a_limited_lake_table_needs_an_order(spark):
    spark.range(9).createOrReplaceTempView("nine")
    assert rows(readers.read_lake_table(spark, "nine", limit=2, order=[F.desc("id")])) == [(8,), (7,)]
    with pytest.raises(ValueError):
        readers.read_lake_table(spark, "nine", limit=2)


def test_columns_of_many_kinds_become_text_and_others_stay(spark):
    texts = [("1", "1", "[1]"), ("true", "2", "[2]"), ('"x"', "3", '{"a": 1}'), ("null", "null", '"y"'), ("2.5", "4.5", "1"), (None, None, "[3]")]
    df = spark.createDataFrame(texts, "mixed string, numbers string, lists string").select(*[F.parse_json(c).alias(c) for c in ("mixed", "numbers", "lists")])
    assert {r["column"]: (r.kinds, r.structured) for r in clean.kind_report(df).collect()} == {"mixed": (4, 0.0), "numbers": (2, 0.0), "lists": (4, 4 / 6)}
    cleaned = clean.auto_clean(df)
    assert dict(cleaned.dtypes) == {"mixed": "string", "numbers": "variant", "lists": "variant"}
    assert [r.mixed for r in cleaned.collect()] == ["1", "true", "x", None, "2.5", None]


def test_evidence_weighs_distinct_values_by_their_rows(spark):
    values = ["12 kWh"] * 6 + ["7"] * 3 + ["N/A"] * 5 + ["x"]
    df = spark.createDataFrame([(v, "free text") for v in values], "reading string, note string")
    found = {r["column"]: r for r in clean.evidence_report(df).collect()}
    assert (found["reading"].filled, found["reading"].numeric, found["reading"].unit, found["reading"].kinds) == (10, 0.9, 0.6, 2)
    assert found["note"].filled == len(values) and found["note"].numeric == 0
