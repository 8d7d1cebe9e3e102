"""Time the bound queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` a comma
list of queries (all of them without it). The training-data queries have a check of their own.
"""

from __future__ import annotations

import json
import os
import time

from tablewright.plans import QUERIES
from tablewright.session import local_session

def run(spark, name: str, folder: str) -> float:
    """Seconds to build the query and compute every row of it."""
    begin = time.time()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.time() - begin, 3)


if __name__ == "__main__":
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(QUERIES)
    spark = local_session(cpus, cpus)
    for name in ("lineitem", "orders"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.format("noop").mode("overwrite").save()
    times = {n: run(spark, n, folder) for n in names}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()
