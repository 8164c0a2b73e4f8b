"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "split_gain_topk", "uvt_histogram", "split_route", "train_tree_d3", "tree_walk", "forest_mean", "confusion_matrix", "image_accuracy", "accuracy_summary",
    "uv_gradient", "infill3x3", "edge_detect", "connected_components", "flood_fill", "joint_weights", "mean_shift_5", "bone_geometry", "quat_radius",
    "velocity_outlier", "asof_bracket_lerp", "codebook_classify", "codebook_fold", "rank_results", "person_assoc",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from posegrid.plans import catalogue

    queries, took = catalogue.queries(), {}
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # the first query of a session starts the Python workers and compiles Spark's own code
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
