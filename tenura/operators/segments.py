"""Group-by reports over one dimension of the subscriber table.

``unique_ids=True`` states that the customer key was checked to be unique (see
``quality.has_unique_ids``); distinct counts then become plain counts, so every
report is one map-side-combined aggregation that shuffles a few rows per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import customers, mean, total, without_nan
from tenura.operators.percentiles import exact_percentiles
from tenura.operators.ranking import metric_rank, null_safe, share_of_total, sort_by_rate
from tenura.schema import (
    CATEGORY_LABELS, CUSTOMER_ID, METRIC_DIMS, METRICS, TARGET, TARGET_FLAG, TARGET_VALUES,
)



def _churn_rate() -> Column:
    return F.avg(TARGET_FLAG) * 100


def with_empty_labels(report: DataFrame, dim: str, zeros: Sequence[str],
                      labels: Sequence[str] | None = None) -> DataFrame:
    """Add a row for every label of an ordered category that no customer has:
    its counts and sums are 0, its averages null. Other dimensions have no
    label list and pass unchanged."""
    labels = labels or CATEGORY_LABELS.get(dim)
    if not labels:
        return report
    every = report.sparkSession.createDataFrame([[x] for x in labels], f"`{dim}` string")
    report = every.join(report, dim, "full").select(*report.columns)
    return report.na.fill(0, list(zeros)) if zeros else report


def segment_analysis(df: DataFrame, dim: str, unique_ids: bool = False,
                     include_empty: bool = True) -> DataFrame:
    """Customers, churn, charges, tenure and revenue per group, worst first."""
    report = df.groupBy(dim).agg(
        customers(CUSTOMER_ID, unique_ids).alias("Customers"),
        F.sum(TARGET_FLAG).alias("Churned_Customers"),
        _churn_rate().alias("Churn_Rate"),
        mean("MonthlyCharges").alias("Avg_Monthly_Charges"),
        mean("TotalCharges").alias("Avg_Total_Charges"),
        mean("tenure").alias("Avg_Tenure"),
        total("Revenue_Lost").alias("Revenue_Lost"),
        total("Annual_Revenue").alias("Annual_Revenue"),
    )
    if include_empty:
        zeros = ["Customers", "Churned_Customers", "Revenue_Lost", "Annual_Revenue"]
        report = with_empty_labels(report, dim, zeros)
    report = report.withColumn("Retention_Rate", 100 - F.col("Churn_Rate"))
    return sort_by_rate(report, "Churn_Rate", dim)


def segment_summary(df: DataFrame, dim: str, unique_ids: bool = False,
                    labels: Sequence[str] | None = None, include_empty: bool = True) -> DataFrame:
    """Per-segment summary in natural order; empty categories are kept."""
    report = df.where(F.col(dim).isNotNull()).groupBy(dim).agg(
        customers(CUSTOMER_ID, unique_ids).alias("Customers"),
        F.sum(TARGET_FLAG).alias("Churned"),
        _churn_rate().alias("Churn_Rate"),
        mean("MonthlyCharges").alias("Avg_Monthly_Charge"),
        mean("Estimated_LTV").alias("Avg_LTV"),
        total("Revenue_Lost").alias("Revenue_Lost"),
    )
    labels = labels or CATEGORY_LABELS.get(dim, [])
    if include_empty:
        report = with_empty_labels(report, dim, ["Customers", "Churned", "Revenue_Lost"], labels)
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(dim)) if labels else dim
    report = report.orderBy(position)
    return report.withColumn("Retention_Rate", 100 - F.col("Churn_Rate"))


def business_query(df: DataFrame, dim: str, unique_ids: bool = False,
                   include_empty: bool = True) -> DataFrame:
    report = df.groupBy(dim).agg(
        customers(CUSTOMER_ID, unique_ids).alias("customer_count"),
        F.sum(TARGET_FLAG).alias("churned_count"),
        F.count_if(F.col(TARGET_FLAG) == 0).alias("retained_count"),
        _churn_rate().alias("churn_rate"),
        ((1 - F.avg(TARGET_FLAG)) * 100).alias("retention_rate"),
        total("MonthlyCharges").alias("monthly_revenue"),
        total("Annual_Revenue").alias("annual_revenue"),
        total("Revenue_Lost").alias("revenue_lost"),
        mean("tenure").alias("average_tenure"),
        mean("MonthlyCharges").alias("average_monthly_charge"),
        mean("Estimated_LTV").alias("average_ltv"),
    )
    if include_empty:
        zeros = ["customer_count", "churned_count", "retained_count", "monthly_revenue",
                 "annual_revenue", "revenue_lost"]
        report = with_empty_labels(report, dim, zeros)
    return sort_by_rate(report, "churn_rate", dim)


def _summary_aggregates(metric: str) -> list:
    value = without_nan(F.col(metric))
    return [
        F.count(value).alias("count"),
        total(metric).alias("sum"),
        mean(metric).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_samp(value).alias("std"),
    ]


def _ranked(report: DataFrame, *partition: str) -> DataFrame:
    return report.withColumns({
        "share_of_total": share_of_total("sum", *partition),
        "metric_rank": metric_rank("mean", *partition),
    })


def metric_summary(df: DataFrame, dim: str, metric: str, include_empty: bool = True
                   ) -> DataFrame:
    """Count to standard deviation of a metric per group, its share and rank."""
    report = df.groupBy(dim).agg(*_summary_aggregates(metric))
    median = exact_percentiles(df, [metric], [0.5], [dim], ["median"]).drop("metric")
    median = median.withColumnRenamed(dim, "_dim")
    report = report.join(median, report[dim].eqNullSafe(median["_dim"]), "left").drop("_dim")
    order = [dim, "count", "sum", "mean", "median", "min", "max", "std"]
    report = report.select(*order)
    if include_empty:
        report = with_empty_labels(report, dim, ["count", "sum"])
    return _ranked(report.withColumn("_all", F.lit(0)), "_all").drop("_all")


def metric_summary_all(df: DataFrame, dims: Sequence[str] = METRIC_DIMS,
                       metrics: Sequence[str] = METRICS, include_empty: bool = True) -> DataFrame:
    """Every dimension by every metric in two passes over the table.

    Only the dimensions are unpivoted (each row once per dimension); the
    metrics stay columns until they are aggregated.
    """
    per_dim = by_dimension(df, dims, metrics)
    keys = ["dim", "dim_value"]
    wide = per_dim.groupBy(*keys).agg(*[
        F.struct(*_summary_aggregates(m)).alias(m) for m in metrics
    ])
    cells = [F.struct(F.lit(m).alias("metric"), F.col(f"{m}.*")) for m in metrics]
    report = wide.select(*keys, F.inline(F.array(*cells)))
    medians = exact_percentiles(per_dim, metrics, [0.5], keys, ["median"])
    keys = [*keys, "metric"]
    report = report.join(medians, null_safe(report, medians, keys), "left").select(
        *[report[c] for c in [*keys, "count", "sum", "mean"]], "median", "min", "max", "std"
    )
    labelled = [(d, x, m) for d in dims for x in CATEGORY_LABELS.get(d, ()) for m in metrics]
    if include_empty and labelled:
        every = df.sparkSession.createDataFrame(labelled, "dim string, dim_value string, metric string")
        empty = every.join(report.select(*keys), keys, "left_anti")
        report = report.unionByName(empty, allowMissingColumns=True).na.fill(0, ["count", "sum"])
    return _ranked(report, "dim", "metric")


def by_dimension(df: DataFrame, dims: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows repeated once per dimension as (dim, dim_value, columns)."""
    return df.select(*columns, *[F.col(d).cast("string").alias(d) for d in dims]).unpivot(
        list(columns), list(dims), "dim", "dim_value"
    )


def churn_rate_by(df: DataFrame, dim: str, include_empty: bool = True) -> DataFrame:
    """The series behind a churn bar chart; a label without customers has no rate."""
    report = df.groupBy(dim).agg(_churn_rate().alias("churn_rate"))
    if include_empty:
        report = with_empty_labels(report, dim, [])
    return sort_by_rate(report, "churn_rate", dim)


def crosstab_counts(df: DataFrame, dim: str, by: str = TARGET,
                    values: Mapping | Sequence = TARGET_VALUES) -> DataFrame:
    """Counts of dim by the given values; null keys are left out. The values
    are stated, so no job is needed to discover them."""
    names = values if isinstance(values, Mapping) else {v: str(v) for v in values}
    known = df.where(F.col(dim).isNotNull() & F.col(by).isNotNull())
    return known.groupBy(dim).agg(*[
        F.count_if(F.col(by) == F.lit(v)).alias(name) for v, name in names.items()
    ])


def crosstab_pct(df: DataFrame, dim: str, by: str = TARGET,
                 values: Mapping | Sequence = TARGET_VALUES, scale: float = 100.0) -> DataFrame:
    """Row-normalised crosstab, in percent (or fractions with scale 1)."""
    counts = crosstab_counts(df, dim, by, values)
    cells = counts.columns[1:]
    row_total = sum((F.col(c) for c in cells[1:]), F.col(cells[0]))
    return counts.select(
        dim, *[(F.try_divide(F.col(c), row_total) * F.lit(scale)).alias(c) for c in cells]
    ).orderBy(dim)


def count_by_hue(df: DataFrame, dim: str, hue: str = TARGET) -> DataFrame:
    """Counts by dimension and hue: the bars of a count plot."""
    known = df.where(F.col(dim).isNotNull() & F.col(hue).isNotNull())
    return known.groupBy(dim, hue).agg(F.count(F.lit(1)).alias("n")).orderBy(dim, hue)


def contingency_counts(df: DataFrame, dim: str, flag: str = TARGET_FLAG) -> DataFrame:
    return crosstab_counts(df, dim, flag, {0: "retained", 1: "churned"}).orderBy(dim)


def class_distribution(df: DataFrame, flag: str = TARGET_FLAG) -> DataFrame:
    """Share of each class of the target, most frequent first."""
    counts = df.where(F.col(flag).isNotNull()).groupBy(flag).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("_all", F.lit(0)).withColumn(
        "proportion", share_of_total("n", "_all")
    )
    return sort_by_rate(shares.select(flag, "proportion"), "proportion", flag)


def cluster_summary(df: DataFrame, unique_ids: bool = False,
                    cluster: str = "Customer_Cluster") -> DataFrame:
    return df.groupBy(cluster).agg(
        customers(CUSTOMER_ID, unique_ids).alias("Customers"),
        mean("tenure").alias("Avg_Tenure"),
        mean("MonthlyCharges").alias("Avg_MonthlyCharges"),
        mean("TotalCharges").alias("Avg_TotalCharges"),
        mean("Service_Count").alias("Avg_Service_Count"),
        _churn_rate().alias("Churn_Rate"),
        total("Revenue_Lost").alias("Revenue_Lost"),
    ).orderBy(cluster)
