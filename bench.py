"""Time every registered query once on $BENCH_SF_DIR and print one JSON line.

Building the plan, planning and full execution (all columns, written to Spark's no-op sink)
are timed together. One untimed query first starts the JVM.
"""

from __future__ import annotations

import json
import os
import re
import time

from driver_queries.queries import QUERIES
from shelfcast.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
ONLY = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]


def run(query, spark) -> float:
    started = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    spark = local_session(
        CPUS,
        "shelfcast-bench",
        {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["fill_rate_by_category"], spark)
    times = {n: run(q, spark) for n, q in QUERIES.items() if not ONLY or n in ONLY}
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else SF_DIR,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
