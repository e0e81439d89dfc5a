"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     cores of the local session (default: all)
BENCH_SINGLES  set to 1 to time the 198 single summaries beside the joint one

``prepare`` is what the others share: deriving and writing the subscriber
table, cleaning it, and fitting the value bands. The rest run on that.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tenura import schema as S
from tenura.operators import segments
from tenura.plans.catalog import build_queries
from tenura.plans.workspace import workspace

HEADLINE = [
    "clean_pipeline", "feature_pipeline", "segment_analysis_contract",
    "segment_analysis_tenure_group", "segment_summary_risk_segment", "business_query_contract",
    "metric_summary_contract_monthlycharges", "metric_summary_all", "crosstab_pct_contract",
    "core_kpis", "kpi_cube", "probabilities", "distribution_stats", "sql_churn_by_contract",
    "sql_risk_ranking", "sql_top_churned", "profile_describe", "quality_report", "welch_t",
    "mann_whitney", "chi_square", "pearson_matrix", "spearman_matrix", "iqr_outliers",
    "target_correlation", "stratified_split", "logistic_regression", "decision_tree", "kmeans_assign", "pca_variance",
    "random_forest", "gradient_boosting", "extra_trees", "reweighted_regression", "kpi_cube_repeating", "quantiles_merged",
]


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="bench-") as shared:
        timed_run(shared)


def timed_run(shared: str) -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", shared)
        # The tables are small: let even 64 KB of shuffled data keep its own task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # No call-site capture for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    w = workspace(spark, data)
    timed("prepare", lambda: (w.clean, w.value_edges, w.unique_ids))
    queries = build_queries()
    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, data).write.format("noop").mode("overwrite").save())
    if os.environ.get("BENCH_SINGLES") == "1":
        timed("metric_summary_198_singles", lambda: [
            segments.metric_summary(w.features, d, m).collect()
            for d in S.METRIC_DIMS for m in S.METRICS
        ])
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(data.rstrip("/")),
        "rows": w.clean.count(), "master": spark.sparkContext.master, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
