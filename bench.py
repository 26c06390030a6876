"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).
Each query is executed fully with the no-op sink (every column computed,
nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["feature_table", "tfidf_rolling", "shared_ngrams_2", "shared_ngrams_3", "shared_ngrams_4",
            "spell_candidates", "oversample", "misspelled_cnt", "aligned_ngrams_2", "length_batches",
            "stratified_split", "describe_features", "plateau_stop", "mean_pool"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    from respscore.plans.registry import QUERIES, load_all
    from respscore.session import build_session, discard_all
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                          extra={"spark.driver.memory": "16g"})
    load_all()
    times = {}
    for q in names:
        t0 = time.time()
        QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[q] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    discard_all(spark)
    spark.stop()


if __name__ == "__main__":
    main()
