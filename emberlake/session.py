"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
#: By application: the paths that ``fresh_path`` has given out.
_GIVEN: dict[str, list[str]] = {}
#: By thread: the paths given out inside each ``scratch`` that is open, the innermost last.
_OPEN = threading.local()
#: Whether shuffle files go when the job that made them is done, instead of when the driver collects its garbage.
_GIVE_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "emberlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; every one can be overridden by ``conf``."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster executors and driver
    would each see a different one, and its content would be lost with the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_ROOTS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has written to yet."""
    path = os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")
    _GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    for inside in getattr(_OPEN, "scopes", [])[-1:]:
        inside.append(path)
    return path


def _remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remove_staged(spark: SparkSession) -> int:
    """Remove what this session has put below its fresh paths; returns how many there were.

    For the owner of a job, once its results are written elsewhere: results that still read staged folders end with them.
    """
    paths = _GIVEN.pop(spark.sparkContext.applicationId, [])
    _remove(spark, paths)
    return len(paths)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several later steps read to the shared folder, and read it back.

    Unlike a cache it survives the loss of executors, and later plans start from a plain scan. What the write has shuffled is
    given up once it is done, as nothing can read it again.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    before = spark.conf.get(_GIVE_UP, None)
    spark.conf.set(_GIVE_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_GIVE_UP) if before is None else spark.conf.set(_GIVE_UP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What this thread stages inside goes at the end, but for what the function given here has staged.

    So the steps of a long operator do not lie on disk together. After an error everything stays, for ``remove_staged``.
    """
    scopes = _OPEN.scopes = getattr(_OPEN, "scopes", [])
    inside: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        result = stage(df, label)
        kept.append(inside[-1])
        return result

    scopes.append(inside)
    try:
        yield keep
    finally:
        scopes.pop()
        if scopes:
            scopes[-1].extend(inside)
    gone = [path for path in inside if path not in kept]
    _remove(spark, gone)
    for paths in (_GIVEN.get(spark.sparkContext.applicationId, []), *scopes[-1:]):
        for path in gone:
            if path in paths:
                paths.remove(path)
