"""Feature engineering: bins, bands, arithmetic, counts, flags, risk segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import count_yes, equals_flag, right_closed_bucket
from tenura.operators.percentiles import exact_percentiles
from tenura.schema import (
    BINS, COUNTED_SERVICES, EQUALITY_FLAGS, RISK_DEFAULT, RISK_LABELS, VALUE_BANDS,
)


def bucket_fixed(df: DataFrame, *names: str) -> DataFrame:
    """Add the named fixed-edge categories (all of them by default)."""
    return df.withColumns({
        name: right_closed_bucket(*BINS[name]) for name in (names or BINS)
    })


def derive_arithmetic(df: DataFrame) -> DataFrame:
    at_least_one_month = F.when(F.col("tenure").isNotNull(), F.greatest("tenure", F.lit(1)))
    return df.withColumns({
        "Tenure_Year": F.col("tenure") / F.lit(12.0),
        "Annual_Revenue": F.col("MonthlyCharges") * 12,
        "Estimated_LTV": F.col("MonthlyCharges") * at_least_one_month,
    })


def derive_revenue_lost(df: DataFrame) -> DataFrame:
    """The charge of a churned customer, zero for a retained one."""
    lost = F.when(F.col("Churn_Flag") == 1, F.col("MonthlyCharges")).otherwise(F.lit(0.0))
    return df.withColumn("Revenue_Lost", lost)


def count_services(df: DataFrame) -> DataFrame:
    return df.withColumns({name: count_yes(cols) for name, cols in COUNTED_SERVICES.items()})


def binary_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({name: equals_flag(c, v) for name, (c, v) in EQUALITY_FLAGS.items()})


def quantile_edges(df: DataFrame, column: str, bands: int) -> list[float]:
    """Lowest value, inner quantiles and highest value of a column."""
    probs = [i / bands for i in range(bands + 1)]
    names = [f"edge{i}" for i in range(bands + 1)]
    row = exact_percentiles(df, [column], probs, names=names).first()
    if row is None:
        raise ValueError(f"{column} holds no values to cut into bands")
    return [row[name] for name in names]


def bucket_quantile(df: DataFrame, column: str = "Estimated_LTV",
                    labels: Sequence[str] = VALUE_BANDS, out: str = "Customer_Value_Band",
                    edges: Sequence[float] | None = None) -> DataFrame:
    """Equal-frequency bands. The few edges are fitted once over the whole
    column, then labelling is a narrow projection."""
    edges = list(edges or quantile_edges(df, column, len(labels)))
    if len(set(edges)) < len(edges):
        raise ValueError(f"{column} has collapsed quantiles: {edges} for {len(labels)} labels")
    return df.withColumn(out, right_closed_bucket(column, edges, labels, include_lowest=True))


def risk_segment(df: DataFrame) -> DataFrame:
    tenure, charge = F.col("tenure"), F.col("MonthlyCharges")
    new = tenure <= 12
    high, medium, potential = RISK_LABELS
    return df.withColumn(
        "Risk_Segment",
        F.when(new & (charge >= 70), high)
        .when(new & (charge < 70), medium)
        .when((tenure > 12) & (charge >= 90), potential)
        .otherwise(RISK_DEFAULT),
    )
