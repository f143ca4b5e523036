"""Headline queries timed on $BENCH_SF_DIR with $BENCH_CPUS threads; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Scoring, slopes, barcodes, replicate combination, ranks, map, agreement, calibration, multiverse, conservation.
NAMES = [
    "slice0_scores", "a4_log_ratio", "a7_slopes", "a13_sum_barcodes", "a16_combine_barcodes_reml", "a23_combine_fixed", "a25_combine_reml", "a31_moderated_combination",
    "j3_apply_barcode_map", "m1_map_grid", "w1_average_ranks", "q1_sample_metrics", "q7_pair_metrics", "k5_areas", "r2_run_specs", "v3_conservation",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from assaylake.plans.catalog import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    seconds = {}
    for name in NAMES:
        start = time.time()
        QUERIES[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
