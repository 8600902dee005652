"""Time the headline queries: one JSON line with the median of the runs after a warm-up, in seconds."""

import json
import os
import statistics
import time

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "segment_revenue", "scan_csv_roundtrip", "arith_add_sub_mul_div", "filter_and", "like_contains", "distinct_two", "distinct_on_first", "sort_multi", "topk_multi",
    "agg_all", "group_multi", "having_some", "join_inner", "join_left", "join_multikey", "join_residual", "pipe_4a", "pipe_5a", "pipe_7a", "pipe_9a", "sql_entry",
)


def main() -> None:
    from sparkloom.plans import catalogue
    from sparkloom.session import get_spark

    spark = get_spark(f"local[{CPUS}]", {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        query = catalogue.queries()[name]
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            query(spark, DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
