"""Streams run to their end, resume, and agree with the same computation on a table."""

from pyspark.sql import functions as F

from emberlake.catalog import streams
from emberlake.sources.published import create_published, manifest, read_published, upsert_published
from emberlake.streaming import jobs as J


def write(spark, path, low, high):
    spark.range(low, high).select("id", (F.col("id") % 3).alias("v")).write.mode("append").parquet(path)


def test_index_build_resumes_and_skips(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("rows.parquet", "target", "progress"))
    schema = "id long, v long"
    write(spark, source, 0, 10)
    stream = lambda: J.table_stream(spark, str(tmp_path), "rows", spark.read.parquet(source).schema, files_per_batch=2)
    J.build_index(spark, stream(), target, progress, "c", id_column="id")
    assert read_published(spark, target).count() == 10
    write(spark, source, 10, 15)
    assert J.build_index(spark, stream(), target, progress, "c", id_column="id") == target
    assert read_published(spark, target).count() == 10  # finished collections are skipped
    J.reset_progress(spark, progress, "c")
    J.build_index(spark, stream(), target, progress, "c", id_column="id")
    assert read_published(spark, target).count() == 15  # continues, nothing twice
    forced = J.build_index(spark, stream(), target, progress, "c", id_column="id", force=True)
    assert forced != target and read_published(spark, forced).count() == 15
    assert J.current_offset(spark, progress, "c") == -1 and J.current_offset(spark, progress, "d") is None
    assert spark.read.schema(schema).parquet(source).count() == 15


def test_alert_handler_gets_batches(spark, tmp_path):
    source = str(tmp_path / "rows.parquet")
    spark.range(10).select(F.col("id").cast("double").alias("duration")).write.parquet(source)
    seen = []
    stream = J.alerts(J.table_stream(spark, str(tmp_path), "rows", spark.read.parquet(source).schema))
    J.notify(stream, lambda batch, number: seen.append({r.level: r["count"] for r in batch.groupBy("level").count().collect()}), str(tmp_path / "c"))
    assert seen == [{"WARNING": 3, "CRITICAL": 4}]


def ids(spark, root):
    return {r.id: r.v for r in read_published(spark, root).collect()}


def test_upsert_rewrites_only_buckets_with_known_ids(spark, tmp_path):
    root = str(tmp_path / "points")
    rows = lambda low, high, v: spark.range(low, high).select("id", F.lit(v).alias("v"))
    create_published(spark, root, rows(0, 1, "a").schema, "id", buckets=4)
    assert read_published(spark, root).count() == 0
    assert upsert_published(root, rows(0, 100, "a")) == 1
    reader = read_published(spark, root)
    first = manifest(spark, root)["folders"]
    assert upsert_published(root, rows(100, 200, "b")) == 2  # no id is known: each bucket gains a folder, none is rewritten
    second = manifest(spark, root)["folders"]
    assert all(len(f) == 2 and f[0] == g[0] for f, g in zip(second, first))
    one = rows(7, 8, "c").unionByName(spark.createDataFrame([(None, "x")], "id long, v string"))
    upsert_published(root, one)
    third = manifest(spark, root)["folders"]
    assert sorted(len(f) for f in third) == [1, 2, 2, 2]  # the bucket of id 7 was merged into one folder
    assert sum(f == g for f, g in zip(third, second)) == 3
    assert ids(spark, root) == {i: "c" if i == 7 else "a" if i < 100 else "b" for i in range(200)}
    assert reader.count() == 100 and reader.where("v <> 'a'").count() == 0  # an open reader keeps its version


def test_upsert_takes_the_first_by_order_and_each_batch_once(spark, tmp_path):
    root = str(tmp_path / "points")
    rows = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "only", 1)], "id long, v string, at int")
    create_published(spark, root, rows.schema, "id", buckets=2)
    assert upsert_published(root, rows, [F.desc("at")], source="s", batch=0) == 1
    assert upsert_published(root, rows.withColumn("v", F.lit("again")), source="s", batch=0) == 1
    assert upsert_published(root, rows.where("id = 2").withColumn("v", F.lit("other")), source="t", batch=0) == 2
    assert ids(spark, root) == {1: "new", 2: "other"}


def test_load_stops_between_batches_and_after_a_failure(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("rows.parquet", "target", "progress"))
    for k in range(4):
        write(spark, source, 10 * k, 10 * k + 10)
    seen = []

    def prepare(batch):
        low = batch.agg(F.min("id")).first()[0]
        seen.append(low)
        if seen.count(20) == 1 and low == 20:
            raise ValueError("a node was lost")
        return batch

    stream = lambda: J.table_stream(spark, str(tmp_path), "rows", spark.read.parquet(source).schema, files_per_batch=8)
    load = lambda **more: J.build_index(spark, stream(), target, progress, "c", id_column="id", buckets=2, prepare=prepare, **more)
    load(max_batches=1)
    assert J.current_offset(spark, progress, "c") == 0
    seen_before = read_published(spark, target).count()
    assert 0 < seen_before < 40
    try:
        load()
    except Exception as error:
        assert "a node was lost" in str(error)
    load()
    assert J.current_offset(spark, progress, "c") == -1
    assert sorted(ids(spark, target)) == list(range(40))


def events_file(spark, path, name, hours):
    spark.createDataFrame([(f"2024-01-01 {h:02d}:{m:02d}:00", 1.0, True) for h in hours for m in (1, 30)], "ts string, duration double, success boolean").withColumn(
        "ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{path}/load={name}.parquet")


def test_windows_leave_the_state_and_late_rows_are_counted(spark, tmp_path):
    path = str(tmp_path)
    for name, hours in (("0", range(0, 5)), ("1", [5, 6]), ("2", [*range(7, 12), 0, 1]), ("3", [23])):
        events_file(spark, path, name, hours)
    stream = J.table_stream(spark, path, "load=*", spark.read.parquet(f"{path}/load=0.parquet").schema, files_per_batch=1)
    batches = J.append_closed(J.windowed_performance(stream), f"{path}/out", f"{path}/checkpoint")
    assert sum(b["rows"] for b in batches) == 30 and max(b["state"] for b in batches) >= 5
    assert batches[-1]["state"] == 1  # only the window of the last row is still open
    assert sum(b["late"] for b in batches) == 2  # the windows of hours 0 and 1 were given out before
    got = {r.window_start.hour: r["count"] for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == {h: 2 for h in range(12)}


def test_counters_merge_only_changed_keys(spark, tmp_path):
    path = str(tmp_path)
    for k, kinds in enumerate([["a", "b"], ["b"], ["c", "a", None]]):
        spark.createDataFrame([(x, True) for x in kinds], "event_type string, success boolean").coalesce(1).write.parquet(f"{path}/load={k}.parquet")
    stream = J.table_stream(spark, path, "load=*", spark.read.parquet(f"{path}/load=0.parquet").schema, files_per_batch=1)
    J.merge_changes(J.counters(stream, ["event_type"]), f"{path}/out", ["event_type"], f"{path}/checkpoint", buckets=8)
    found = {r.event_type: r.total for r in read_published(spark, f"{path}/out").collect()}
    assert found == {"a": 2, "b": 2, "c": 1, None: 1}
    versions = [r.folders for r in spark.read.parquet(f"{path}/out/manifest").orderBy("version").collect()]
    changed = [sum(a != b for a, b in zip(old, new)) for old, new in zip(versions, versions[1:])]
    assert len(changed) == 3 and all(1 <= n <= most for n, most in zip(changed, (2, 1, 3)))


def test_large_loads_are_several_files_and_one_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 10, raising=False)
    monkeypatch.setattr(streams, "fresh_path", lambda spark, label: str(tmp_path / label))
    keys = [k % 10 for k in range(95)] + [12, 39, None]
    spark.createDataFrame([(k,) for k in keys], "key long").write.parquet(str(tmp_path / "orders.parquet"))
    stream, got = streams._landed(spark, str(tmp_path), "orders", "key"), {}

    def note(batch, number):
        got[number] = sorted((r.key for r in batch.collect()), key=str)

    J._run(stream.writeStream.foreachBatch(note), str(tmp_path / "checkpoint"))
    assert got == {0: sorted(keys[:95]), 1: [12], 2: [], 3: [39, None]}
    assert [len(list((tmp_path / "landed" / f"load={k}.parquet").glob("*.parquet"))) for k in range(4)] == [10] * 4
