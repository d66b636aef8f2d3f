"""Time the named queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES (comma separated)
the queries to run; the default is all of them. A query is timed from building its
plan, probes and streams included, to the last row going to a sink that drops it; the
better of two runs counts, so that compiling its code the first time does not.
"""

from __future__ import annotations

import json
import os
import time

from dockledger.plans import REGISTRY
from dockledger.session import local_session


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].build(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(REGISTRY)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {
        name: round(min(run(spark, name, folder), run(spark, name, folder)), 3) for name in names
    }
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
