"""Bench: run the catalogue queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one
JSON line with seconds per query. Each query is fully executed into the no-op sink
(no driver collect)."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkfeat.plans.registry import specs  # noqa: E402
from sparkfeat.session import get_spark  # noqa: E402

def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:]]
    spark = get_spark(f"local[{cpus}]", cpus * 2, app_name="sparkfeat-bench",
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.range(1000).selectExpr("sum(id)").collect()   # JVM / codegen warm-up, not timed
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, spec in specs().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            spec.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
           "n_queries": len(times)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
