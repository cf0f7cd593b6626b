"""Time the headline jobs; prints one JSON line.

Each job runs twice and its faster run counts, so that starting the engine and
compiling code are not measured. Names given as arguments replace the list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from gridtally.plans.catalog import QUERIES
from gridtally.plans.session import local_session

HEADLINE = """
replication_advice interval_access dataset_frequency cloud_shares site_shares
placement_cloud placement_site advice_by_project frequency_for_list
next_period_validation rolling_advice advice_outcome overall_popularity
utilisation_sites utilisation_clouds dashboard_sites joined_sites metric_pivot
metric_pivot_median single_dataset_wide most_popular replica_inventory
processed_by_site storage_locality site_accounting bucket_flatten task_execution
training_extract subset_extract upsert_by_task doc_id_dedup csv_union
""".split()


def seconds(spark, fn, sf_dir: str) -> float:
    started = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    taken = time.perf_counter() - started
    spark.catalog.clearCache()
    return taken


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cores=cores, shuffle_partitions=cores)
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = [seconds(spark, QUERIES[name], sf_dir) for _ in range(2)]
        timings[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
