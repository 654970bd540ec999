"""Times the headline queries; prints one JSON line.

Each query runs once to warm up, then BENCH_RUNS times; its figure is the median. Results are fully computed
into Spark's no-op sink. With BENCH_SQL=1 the SQL that gives the same rows runs in Spark too, as far as Spark can
parse it, and the times and ratios go to standard error.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "q_flagship_top_customers", "c5_three_hops", "c6_closing_cycle", "c8_two_matches", "c9_optional_where", "c14_exists_multi_hop", "c16_not_exists", "c17_exists_under_or", "b4_multi_type_hop",
    "d3_vlp", "d1_vlp_deep", "d14_vlp_all_edges", "d15_terminator", "d19_vlp_continuation", "d20_bidirectional", "d23_reachability", "e7_having", "h1_aggregates", "h13_ordered_collect", "a5_boundary",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loomgraph.catalogue import ORACLE_SQL, QUERIES

    names = sys.argv[1:] or HEADLINE
    times = {}

    def timed(make) -> list[float]:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return took

    if os.environ.get("BENCH_SQL"):
        for t in Path(sf_dir).glob("*.parquet"):
            spark.read.parquet(str(t)).createOrReplaceTempView(t.stem)
    for name in names:
        took = timed(lambda name=name: QUERIES[name](spark, sf_dir))
        times[name] = round(statistics.median(took[1:]), 3)
        print(name, *(round(t, 2) for t in took), file=sys.stderr, flush=True)
        if os.environ.get("BENCH_SQL"):
            try:
                sql = statistics.median(timed(lambda name=name: spark.sql(ORACLE_SQL[name]))[1:])
                print(f"  | {name} | {times[name]:.2f} | {sql:.2f} | {times[name] / sql:.2f} |", file=sys.stderr, flush=True)
            except Exception as e:  # another dialect
                print(f"  | {name} | {times[name]:.2f} | - | {type(e).__name__} |", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
