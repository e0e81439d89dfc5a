"""Cleaning: headers, whitespace, numbers, duplicates, missing totals, flags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.functions.columns import map_values, strip, to_number
from tenura.schema import NUMERIC_COERCIONS


def clean_column_names(df: DataFrame) -> DataFrame:
    """Strip headers and turn spaces and hyphens into underscores."""
    return df.toDF(*[c.strip().replace(" ", "_").replace("-", "_") for c in df.columns])


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(*[
        strip(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def coerce_numbers(df: DataFrame, types: Mapping[str, str] = NUMERIC_COERCIONS) -> DataFrame:
    """Make the listed columns numeric; unreadable text becomes null."""
    return df.withColumns({c: to_number(c, t) for c, t in types.items()})


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each set of identical rows. Copies collapse before the shuffle."""
    return df.dropDuplicates()


def fill_total(df: DataFrame) -> DataFrame:
    """A missing TotalCharges is what was charged so far, else zero."""
    so_far = F.col("MonthlyCharges") * F.col("tenure")
    return df.withColumn("TotalCharges", F.coalesce("TotalCharges", so_far, F.lit(0.0)))


def map_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "Churn_Flag": map_values("Churn", {"Yes": 1, "No": 0}, "tinyint"),
        "SeniorCitizen_Label": map_values("SeniorCitizen", {0: "No", 1: "Yes"}, "string"),
    })
