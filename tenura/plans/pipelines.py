"""The cleaning and feature steps in their working order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tenura.operators import clean, features


def clean_pipeline(df: DataFrame) -> DataFrame:
    return (
        df.transform(clean.clean_column_names)
        .transform(clean.trim_strings)
        .transform(clean.coerce_numbers)
        .transform(clean.drop_duplicates)
        .transform(clean.fill_total)
        .transform(clean.map_flags)
    )


def row_features(df: DataFrame) -> DataFrame:
    """Every feature that depends on its own row alone: one narrow projection."""
    return (
        df.transform(features.bucket_fixed)
        .transform(features.derive_arithmetic)
        .transform(features.derive_revenue_lost)
        .transform(features.count_services)
        .transform(features.binary_flags)
        .transform(features.risk_segment)
    )


def feature_pipeline(df: DataFrame, value_edges: Sequence[float] | None = None) -> DataFrame:
    """All engineered columns. Without given edges the value bands are fitted on
    ``df``, which reads it once more; pass a written table for large inputs."""
    return row_features(df).transform(features.bucket_quantile, edges=value_edges)
