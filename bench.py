"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

A new session has no stage tables, so ``stage_*`` are measured from raw tables and the
stages before them; the queries below read the stages.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from panelyard.plans import catalog  # noqa: E402

HEADLINE = (
    "asset_returns", "return_features", "index_features", "rank_normalise", "winsorise",
    "decile_book", "decile_turnover", "weights_tilt", "cap_weights", "net_accounting",
    "statistical_table", "economic_table", "cost_sensitivity", "alpha_vs_benchmark",
    "factor_alpha", "decay_analysis", "tilt_by_cost", "tilt_by_category", "walk_forward_folds",
    "densify", "objective_sharpe", "baseline_fits", "ensemble_average", "capacity_comparison",
    "walk_forward_all_baselines", "linear_objective_gradient", "boosted_trees",
)
STAGES = {
    "stage_turnover": catalog.turnover_stage, "stage_panel": catalog.panel_stage,
    "stage_predictions": catalog.prediction_stage, "stage_book": catalog.book_stage,
    "stage_monthly": catalog.monthly_stage, "stage_schemes": catalog.schemes_stage,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    took: dict[str, float] = {}
    for name, build in STAGES.items():
        began = time.time()
        build(spark, sf_dir)
        took[name] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
