"""Published collections: rows by id in hash buckets, with a manifest that names the current files under one path.

``<root>/data/<version>/bucket=<b>`` holds rows, ``<root>/manifest/version=<n>`` one row that names, for every bucket, the folders
that make up version ``n``. Readers take the newest manifest row, so they see an upsert as a whole or not at all, under the same
path, and a reader that has begun keeps its version. An upsert writes the new rows by bucket first. Buckets in which none of
the new ids occurs gain a folder; only buckets in which one does are written anew. A load made of disjoint chunks thus writes
each row once.

Batches carry a source and a number. A batch whose number the manifest already holds for its source is left out, so a batch that is
repeated after a failure changes nothing; files of an attempt that never reached the manifest are read by nobody.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberlake.operators.combine import newest_per_key

_MANIFEST = "id_column string, columns string, folders array<array<string>>, done map<string, bigint>, version long"
_BUCKET = "__bucket"


def _bucket(id_column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_column)), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, root: str) -> Row:
    """The newest manifest row of a collection."""
    rows = spark.read.schema(_MANIFEST).parquet(os.path.join(root, "manifest"))
    newest = rows.agg(F.max("version").alias("version"))
    return rows.join(newest, "version").first()


def _publish(spark: SparkSession, root: str, version: int, id_column: str, columns: str, folders: list[list[str]], done: dict[str, int]) -> int:
    # An existing version is an error: of two writers at once the second must start again from the new version.
    row = spark.createDataFrame([(id_column, columns, folders, done)], _MANIFEST.rsplit(", ", 1)[0])
    row.coalesce(1).write.mode("errorifexists").parquet(os.path.join(root, "manifest", f"version={version}"))
    return version


def create_published(spark: SparkSession, root: str, schema: StructType, id_column: str, buckets: int = 16) -> int:
    """An empty collection for rows of ``schema``. ``buckets`` stays as it is; take enough that one fits into a few tasks."""
    return _publish(spark, root, 0, id_column, schema.json(), [[] for _ in range(buckets)], {})


def exists(spark: SparkSession, root: str) -> bool:
    try:
        spark.read.schema(_MANIFEST).parquet(os.path.join(root, "manifest"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _rows(spark: SparkSession, root: str, about: Row, buckets: Sequence[int]) -> DataFrame:
    schema = StructType.fromJson(json.loads(about["columns"]))
    paths = [os.path.join(root, "data", folder, f"{_BUCKET}={b}") for b in buckets for folder in about["folders"][b]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the newest version, one per id."""
    about = manifest(spark, root)
    return _rows(spark, root, about, range(len(about["folders"])))


def _write(rows: DataFrame, root: str, about: Row) -> str:
    """Store rows by bucket in a new folder and return its name."""
    folder = uuid.uuid4().hex
    dealt = rows.withColumn(_BUCKET, _bucket(about["id_column"], len(about["folders"])))
    dealt.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(os.path.join(root, "data", folder))
    return folder


def upsert_published(
    root: str, new: DataFrame, order: Sequence[Column] = (), *, source: str = "", batch: int | None = None
) -> int:
    """Merge rows into a collection, the last written row of an id wins, and return the version that readers now see.

    ``order`` sorts several new rows of one id, best first; without it any of them is taken. Rows without an id are left out.
    ``batch`` is the number of these rows among those of ``source``; a number already merged is not merged again.
    """
    spark = new.sparkSession
    about = manifest(spark, root)
    if batch is not None and about["done"].get(source, -1) >= batch:
        return about["version"]
    key, count = about["id_column"], len(about["folders"])
    known = new.where(F.col(key).isNotNull())
    latest = newest_per_key(known, [key], order, 1) if order else known.dropDuplicates([key])
    columns = StructType.fromJson(json.loads(about["columns"])).names
    fresh = _write(latest.select(*columns), root, about)
    stored = spark.read.schema(f"{key} {latest.schema[key].dataType.simpleString()}, {_BUCKET} int").parquet(os.path.join(root, "data", fresh))
    touched = [r[0] for r in stored.select(_BUCKET).distinct().collect()]  # bucket numbers, as many as there are buckets
    filled = [b for b in touched if about["folders"][b]]
    ids = stored.select(key)
    clash: list[int] = []
    if filled:  # reads ids only
        met = _rows(spark, root, about, filled).select(key).join(ids, key, "left_semi")
        clash = [r[0] for r in met.select(_bucket(key, count).alias("b")).distinct().collect()]
    folders = [list(f) for f in about["folders"]]
    for b in touched:
        folders[b].append(fresh)
    if clash:
        kept = _rows(spark, root, about, clash).join(ids, key, "left_anti")
        added = _rows(spark, root, Row("columns", "folders")(about["columns"], [[fresh]] * count), clash)
        merged = _write(kept.unionByName(added), root, about)
        for b in clash:
            folders[b] = [merged]
    done = about["done"] | ({} if batch is None else {source: batch})
    return _publish(spark, root, about["version"] + 1, key, about["columns"], folders, done)
