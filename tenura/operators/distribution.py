"""Distribution figures and interquartile outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.operators.percentiles import exact_percentiles, modes
from tenura.functions.columns import mean, without_nan
from tenura.schema import METRICS, OUTLIER_FEATURES


def sample_skewness(value: Column, n: Column) -> Column:
    """Bias-corrected skewness; null for fewer than three values."""
    factor = F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.skewness(value) * factor


def sample_kurtosis(value: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; null for fewer than four values."""
    factor = (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
    return factor * ((n + 1) * F.kurtosis(value) + 6)


def distribution_stats(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Fifteen figures per metric, one row each. NaN counts as missing."""
    cells = []
    for m in metrics:
        value = without_nan(F.col(m))
        n = F.count(value).cast("double")
        cells.append(F.struct(
            F.lit(m).alias("metric"),
            F.count(value).alias("count"),
            mean(m).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.var_samp(value).alias("variance"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            sample_skewness(value, n).alias("skew"),
            sample_kurtosis(value, n).alias("kurtosis"),
        ))
    moments = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    quartiles = exact_percentiles(df, metrics, [0.25, 0.5, 0.75], names=["q1", "q2", "q3"])
    joined = moments.join(quartiles, "metric", "left").join(modes(df, metrics), "metric", "left")
    return joined.select(
        "metric", "count", "mean", F.col("q2").alias("median"), "mode", "std", "variance", "min",
        "q1", "q2", "q3", "max", (F.col("max") - F.col("min")).alias("range"),
        (F.col("q3") - F.col("q1")).alias("iqr"), "skew", "kurtosis",
    )


def iqr_bounds(df: DataFrame, features: Sequence[str] = OUTLIER_FEATURES) -> DataFrame:
    """Quartiles and the fences 1.5 interquartile ranges beyond them."""
    quartiles = exact_percentiles(df, features, [0.25, 0.75], names=["Q1", "Q3"])
    iqr = F.col("Q3") - F.col("Q1")
    return quartiles.select(
        F.col("metric").alias("Feature"), "Q1", "Q3", iqr.alias("IQR"),
        (F.col("Q1") - 1.5 * iqr).alias("Lower_Bound"),
        (F.col("Q3") + 1.5 * iqr).alias("Upper_Bound"),
    )


def outlier_rows(df: DataFrame, features: Sequence[str] = OUTLIER_FEATURES,
                 key: str = "customerID") -> DataFrame:
    """Each (customer, feature, value) that lies strictly outside its fences."""
    bounds = F.broadcast(iqr_bounds(df, features))   # one row per feature
    values = df.select(key, *[without_nan(F.col(f)).alias(f) for f in features]).unpivot(
        [key], list(features), "Feature", "value"
    )
    outside = (F.col("value") < F.col("Lower_Bound")) | (F.col("value") > F.col("Upper_Bound"))
    return values.join(bounds, "Feature").where(outside).select(
        key, "Feature", "value", "Lower_Bound", "Upper_Bound"
    )


def iqr_outliers(df: DataFrame, features: Sequence[str] = OUTLIER_FEATURES) -> DataFrame:
    """Fences and the number of values outside them, per feature."""
    fences = {r["Feature"]: r for r in iqr_bounds(df, features).collect()}  # one per feature
    cells = [
        F.struct(
            F.lit(f).alias("Feature"),
            *[F.lit(r[c]).alias(c) for c in ("Q1", "Q3", "IQR", "Lower_Bound", "Upper_Bound")],
            F.count_if(
                (without_nan(F.col(f)) < F.lit(r["Lower_Bound"])) | (without_nan(F.col(f)) > F.lit(r["Upper_Bound"]))
            ).alias("Outlier_Count"),
        )
        for f, r in ((f, fences[f]) for f in features if f in fences)
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
