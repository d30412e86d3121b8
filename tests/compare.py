"""Run registered queries on Spark and their SQL text on DuckDB, and compare the rows."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from emberlake.sources.readers import TABLE_NAMES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return ("f", 0.0 if value == 0 else value)
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    raise TypeError(f"results must hold plain values, not {type(value).__name__}: {value!r}")


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in df.select(*names).collect())


def sql_rows(con, text: str) -> tuple[list[str], Counter]:
    found = con.execute(text)
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in found.fetchall())


def difference(df, con, text: str) -> str | None:
    """A short account of what differs, or ``None``."""
    names, ours = spark_rows(df)
    other_names, theirs = sql_rows(con, text)
    if names != other_names:
        return f"columns {names} vs {other_names}"
    if ours != theirs:
        left, right = ours - theirs, theirs - ours
        return f"{sum(ours.values())} vs {sum(theirs.values())} rows; ours only {list(left)[:3]}; SQL only {list(right)[:3]}"
    return None


def main(folder: str, wanted: list[str]) -> int:
    from emberlake.catalog import QUERIES, SQL
    from emberlake.session import build_session

    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name, run in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in SQL:
                problem = difference(run(spark, folder), con, SQL[name])
                note = "same rows" if problem is None else problem
            else:
                problem, note = None, f"{run(spark, folder).count()} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            problem = note = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failing")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
