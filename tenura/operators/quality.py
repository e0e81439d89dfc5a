"""Data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.schema import CUSTOMER_ID, TARGET, TARGET_VALUES


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows; nulls are equal."""
    copies = df.groupBy(*df.columns).count()
    return copies.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def missing_by_column(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], row.columns, "column_name", "missing").orderBy(
        F.col("missing").desc(), "column_name"
    )


def check_unique_customers(df: DataFrame, key: str = CUSTOMER_ID) -> DataFrame:
    return df.agg(F.count_distinct(key).alias("unique_customers"))


def has_unique_ids(df: DataFrame, key: str = CUSTOMER_ID) -> bool:
    """Whether no key occurs twice. Keys are counted before they are shuffled,
    so a key with very many rows costs no more than any other."""
    return df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()


def check_negative(df: DataFrame, columns: Sequence[str] = ("MonthlyCharges", "TotalCharges")
                   ) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).try_cast("double") < 0).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column_name", "negative")


def check_invalid_values(df: DataFrame, column: str = TARGET,
                         allowed: Sequence[str] = TARGET_VALUES) -> DataFrame:
    """Values of the column outside the allowed set, sorted. Run it on the raw
    table: cleaning maps unknown values to null."""
    found = df.select(F.col(column).alias("invalid_value")).dropna()
    return found.where(~F.col("invalid_value").isin(list(allowed))).distinct().orderBy(
        "invalid_value"
    )


def quality_report(df: DataFrame, key: str = CUSTOMER_ID, column: str = TARGET,
                   allowed: Sequence[str] = TARGET_VALUES) -> DataFrame:
    """All checks as (check_name, value): every per-row figure in one pass, the
    three that need a shuffle beside it."""
    per_row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]),
            F.count_if(F.col(df.columns[0]).isNull())).alias("missing_values"),
        F.count_if(F.col("MonthlyCharges").try_cast("double") < 0).alias("negative_charges"),
        F.count_if(F.col("TotalCharges").try_cast("double") < 0).alias("negative_total_charges"),
    )
    parts = [
        per_row.unpivot([], per_row.columns, "check_name", "value"),
        duplicate_rows(df).select(F.lit("duplicates"), "duplicate_rows"),
        check_unique_customers(df, key).select(F.lit("unique_customers"), "unique_customers"),
        check_invalid_values(df, column, allowed).agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("invalid_target_values"), "n"),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.union(part)
    return report
