"""Business KPIs, probabilities, the JSON report and the dashboard queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import customers, mean, total
from tenura.schema import CUSTOMER_ID, SLICERS, TARGET_FLAG


def _long(row: DataFrame, name: str, value: str) -> DataFrame:
    """A one-row frame of figures as (name, value) rows."""
    doubles = row.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in row.columns])
    return doubles.unpivot([], [f"`{c}`" for c in row.columns], name, value)


def core_kpis(df: DataFrame, unique_ids: bool = False) -> DataFrame:
    """The twelve headline figures from a single aggregation."""
    people = customers(CUSTOMER_ID, unique_ids)
    return _long(df.agg(
        people.alias("Total Customers"),
        F.sum(TARGET_FLAG).alias("Churned Customers"),
        F.count_if(F.col(TARGET_FLAG) == 0).alias("Retained Customers"),
        (F.avg(TARGET_FLAG) * 100).alias("Churn Rate (%)"),
        (100 - F.avg(TARGET_FLAG) * 100).alias("Retention Rate (%)"),
        total("MonthlyCharges").alias("Monthly Revenue"),
        total("Annual_Revenue").alias("Annual Revenue"),
        total("Revenue_Lost").alias("Revenue Lost from Churn"),
        mean("MonthlyCharges").alias("Average Monthly Charge"),
        mean("tenure").alias("Average Tenure"),
        mean("Estimated_LTV").alias("Average Estimated LTV"),
        F.try_divide(total("MonthlyCharges"), people).alias("ARPU"),
    ), "kpi", "value")


def business_report(df: DataFrame, unique_ids: bool = False) -> DataFrame:
    """The ten-field report as one row."""
    return df.agg(
        customers(CUSTOMER_ID, unique_ids).alias("customers"),
        F.sum(TARGET_FLAG).alias("churned"),
        F.count_if(F.col(TARGET_FLAG) == 0).alias("retained"),
        (F.avg(TARGET_FLAG) * 100).alias("churn_rate_pct"),
        ((1 - F.avg(TARGET_FLAG)) * 100).alias("retention_rate_pct"),
        total("MonthlyCharges").alias("monthly_revenue"),
        total("Annual_Revenue").alias("annual_revenue"),
        total("Revenue_Lost").alias("revenue_lost"),
        mean("tenure").alias("average_tenure"),
        mean("MonthlyCharges").alias("average_monthly_charge"),
    )


def report_json(report: DataFrame) -> DataFrame:
    """Any report as indented JSON text, one document per row."""
    return report.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("report"))


def report_fields(documents: DataFrame, schema: str) -> DataFrame:
    """The fields of JSON documents again, by a schema; what a document lacks is null."""
    return documents.select(F.from_json("report", schema).alias("r")).select("r.*")


def probabilities(df: DataFrame) -> DataFrame:
    """Marginal, conditional and joint churn probabilities, with the joint one
    rebuilt from its factors."""
    monthly = F.coalesce(F.col("Contract") == "Month-to-month", F.lit(False))
    electronic = F.coalesce(F.col("PaymentMethod") == "Electronic check", F.lit(False))
    flag = F.col(TARGET_FLAG)
    row = df.agg(
        F.avg(flag).alias("p_churn"),
        (1 - F.avg(TARGET_FLAG)).alias("p_no_churn"),
        F.avg(F.when(monthly, flag)).alias("p_churn_given_month_to_month"),
        F.avg(F.when(electronic, flag)).alias("p_churn_given_electronic_check"),
        F.avg(F.when(monthly & (flag == 1), 1.0).otherwise(0.0))
        .alias("p_month_to_month_and_churn"),
        F.avg(F.when(monthly, 1.0).otherwise(0.0)).alias("p_month_to_month"),
    )
    rebuilt = F.col("p_churn_given_month_to_month") * F.col("p_month_to_month")
    return _long(row.withColumn("p_joint_reconstructed", rebuilt), "probability", "value")


# --- dashboard --------------------------------------------------------------

def _cards(unique_ids: bool) -> list[Column]:
    return [
        (100 - F.avg(TARGET_FLAG) * 100).alias("retention_rate"),
        customers(CUSTOMER_ID, unique_ids).alias("total_customers"),
        F.count_if(F.col(TARGET_FLAG) == 0).alias("retained_customers"),
        mean("MonthlyCharges").alias("avg_monthly_charges"),
        total("MonthlyCharges").alias("monthly_revenue"),
    ]


def kpi_cards(df: DataFrame, filters: Mapping[str, Sequence[str]] | None = None,
              unique_ids: bool = False) -> DataFrame:
    """The five cards for the chosen slicer values; filters reach the scan."""
    for name, values in (filters or {}).items():
        df = df.where(F.col(name).isin(list(values)))
    return df.agg(*_cards(unique_ids))


def kpi_cube(df: DataFrame, slicers: Sequence[str] = SLICERS, unique_ids: bool = False
             ) -> DataFrame:
    """The cards for every combination of slicers; level 0 is the finest."""
    return df.cube(*slicers).agg(F.grouping_id().alias("level"), *_cards(unique_ids))


def churn_by_tenure_month(df: DataFrame) -> DataFrame:
    return df.groupBy("tenure").agg((F.avg(TARGET_FLAG) * 100).alias("churn_rate")).orderBy("tenure")


def customers_by(df: DataFrame, dim: str, unique_ids: bool = False) -> DataFrame:
    return df.groupBy(dim).agg(customers(CUSTOMER_ID, unique_ids).alias("customers")).orderBy(dim)
