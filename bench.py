"""Times the headline queries over the tables in $BENCH_SF_DIR and prints one JSON line.

Each query runs once to warm the session up (JIT, Python workers) and once for the record; the result is written to a
sink that discards it, so nothing is collected. ``rows_per_sec`` relates the recorded time to the input pages."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagemill.plans import QUERIES  # noqa: E402
from pagemill.session import get_session  # noqa: E402

HEADLINE = {  # query -> table whose rows become its pages
    "page_links": "pages", "page_anchors": "pages", "site_inlinks": "pages", "known_under": "pages",
    "extract_parts": "part", "extract_orders": "orders", "facts_customers": "customer", "fill_rates": "orders",
    "pager_links": "orders", "walk_items": "orders", "iso_dates": "orders", "second_opinion": "labels",
    "mode_selector": "events", "greedy_assignment": "orders",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or list(HEADLINE)
    sizes = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in {HEADLINE.get(q, "pages") for q in chosen}}
    times, rates = {}, {}
    for name in chosen:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        rates[name] = round(sizes[HEADLINE.get(name, "pages")] / times[name], 1)
        print(f"{name}: {times[name]} s, {rates[name]} rows/s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "rows_per_sec": rates, "cpus": int(cpus), "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
