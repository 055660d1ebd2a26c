"""Benchmark: wall time of the headline queries.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints one JSON line.  Each query is fully computed with the ``noop`` sink
(no collect to the driver); the reported time is the median of $BENCH_RUNS runs
after one warm-up run.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["citation_acm", "invert_citations", "index_postings", "search_scored", "similar_tfidf", "nb_model"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE

    from citegraph.plans.queries import QUERIES
    from citegraph.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times, rows = {}, {}
    for name in names:
        q = QUERIES[name]
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            df = q(spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                samples.append(dt)
        times[name] = round(statistics.median(samples), 3)
        rows[name] = q(spark, sf_dir).count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "sf": float(m.group(1)) if m else sf_dir,
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
