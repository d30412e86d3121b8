"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores. Every query is written to the ``noop`` sink, so all
rows and columns are computed; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import time

from emberlake.catalog import QUERIES
from emberlake.session import build_session

HEADLINE = [
    "jon01_eight_keys", "snk04_upsert", "vec02_nearest", "vec06_hybrid", "vec13_many_queries", "epc01_category_counts",
    "epc03_monthly_changes", "epc16_low_energy_lighting_share", "mtr03_consumption_by_meter", "prf02_null_report", "prf04_describe",
    "prf05_top_values", "prf07_correlations", "prf09_iqr_outliers", "cln03_smart_number", "cln10_auto_clean", "txt08_intents",
    "txt10_best_pattern", "txt18_schema_search", "txt19_enhance", "vec11_text_search", "log01_summary", "lrn02_evolve_patterns",
    "str02_windows_on_stream", "inc05_chunked_build",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        # Local files open fast: let small tables split into as many tasks as there are cores.
        "spark.sql.files.openCostInBytes": "1m",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    rows = QUERIES["inc05_chunked_build"](spark, folder).count()
    spark.stop()
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "build_rows_per_sec": round(rows / times["inc05_chunked_build"]),
    }))


if __name__ == "__main__":
    main()
