"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from candidate_funnel.catalog.queries import QUERIES

HEADLINE = [
    "flagship_funnel",
    "pair_rmsd",
    "pair_best_rmsd",
    "pair_aligned_rmsd",
    "leader_cluster",
    "dedup_two_gate",
    "prune_diverse",
    "top_k",
    "score_rank",
    "score_window",
    "cap_per_key",
    "coverage_route",
    "strip_leaves",
    "agg_stats",
    "agg_boltzmann",
    "boltzmann_weights",
    "fingerprint_2048",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("candidate_funnel bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    # The first round compiles code and starts Python workers; the second counts.
    for _ in range(2):
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
