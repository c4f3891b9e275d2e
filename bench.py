"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line. A query's time is the median of three warm runs into a sink that reads every row."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from millrace.operators import relational, windows  # noqa: E402
from millrace.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
N = 10_000_000
#: The driver's tables.
TABLES = (
    "flagship", "flt_where", "prj_computed", "jn_inner", "jn_full", "jn_large_then_group", "ag_hash_aggregate", "ag_two_keys", "ag_reduce_running", "ag_ordered_fold", "fmp_word_count", "wn_tumbling",
    "wn_sliding", "wn_session", "st_on_time", "st_late_rows_dropped", "nexmark_q1", "nexmark_q2", "nexmark_q5", "nexmark_q8_by_seller", "sql_grouped_sum", "job_from_json",
)


def numbers(spark):
    return spark.range(N).select("id", F.col("id").cast("double").alias("value"))


#: Operators over 10 million generated rows; their rows a second are reported too.
GENERATED = {
    "gen_filter": lambda s: relational.where(numbers(s), F.col("value") > N / 2),
    "gen_project": lambda s: relational.project(numbers(s), [(F.col("value") * 2 + 1, "v")]),
    "gen_filter_project": lambda s: relational.project(relational.where(numbers(s), F.col("value") > N / 2), [(F.col("value") * 2, "v")]),
    "gen_aggregate_100_groups": lambda s: relational.hash_aggregate(numbers(s).select((F.col("id") % 100).alias("g"), "value"), [0], [relational.Aggregate("sum", 1, "s"), relational.Aggregate("count", 1, "n")]),
    "gen_keyed_sum_1024": lambda s: relational.grouped_sum(numbers(s).select((F.col("id") % 1024).alias("k"), "value"), ["k"], "value", "s"),
    "gen_keyed_sum_1m": lambda s: relational.grouped_sum(numbers(s).select((F.col("id") % 1_000_000).alias("k"), "value"), ["k"], "value", "s"),
    "gen_join_10k_build": lambda s: relational.hash_join(s.range(10_000).toDF("b"), numbers(s).select((F.col("id") % 10_000).alias("p"), "value"), [0], [0]),
    "gen_window_100_keys": lambda s: windows.window_aggregate(numbers(s).select((F.col("id") % 100).alias("k"), (F.col("id") % 1_000_000).alias("t"), "value"), windows.Tumbling(10_000), 1, [0], [relational.Aggregate("sum", 2, "s"), relational.Aggregate("count", 2, "n")]),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took = {}

    def timed(name, make):
        runs = []
        for k in range(RUNS + 1):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 4)

    for name in TABLES:
        timed(name, lambda name=name: QUERIES[name](spark, SF_DIR))
    for name, make in GENERATED.items():
        timed(name, lambda make=make: make(spark))
    out = {"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_second": {k: round(N / took[k]) for k in GENERATED}, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
