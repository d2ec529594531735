"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = ("flagship", "k06_minimum_maximum", "k08_multiple_of", "k21_contains", "k25_any_of", "k31_full_text_search", "v01_variant_minimum", "v03_variant_vacuous", "j01_links", "j03_link_in_any_of", "j04_link_in_not", "j05_nested_links", "j10_linked_order_skip_limit", "l06_skip", "l07_limit_after_links", "p08_linked_payload", "w01_row_number_per_parent", "s12_linked_at", "z02_markers", "r05_classify_snapshots")


def main() -> None:
    sf_dir, cpus, repeats = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_REPEATS", "3"))
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from graphloom.plans import catalog

    queries, times = catalog.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
