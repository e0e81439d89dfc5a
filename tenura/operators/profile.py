"""First look at a table: shape, rows, schema, describe, distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.functions.columns import without_nan
from tenura.operators.percentiles import exact_percentiles
from tenura.schema import CUSTOMER_ID, RANDOM_SEED


def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.lit(", ".join(df.columns)).alias("column_names"),
    )


def profile_head(df: DataFrame, n: int = 5, key: str = CUSTOMER_ID) -> DataFrame:
    """First rows by key: a bounded top-n per task, no full sort."""
    return df.orderBy(key).limit(n)


def profile_tail(df: DataFrame, n: int = 5, key: str = CUSTOMER_ID) -> DataFrame:
    return df.orderBy(F.col(key).desc()).limit(n)


def profile_sample(df: DataFrame, n: int = 5, seed: int = RANDOM_SEED,
                   key: str = CUSTOMER_ID) -> DataFrame:
    """Seeded sample without replacement; the same rows under any partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(digest, key).limit(n)


def _per_column(df: DataFrame, aggregate, out: str) -> DataFrame:
    row = df.agg(*[aggregate(c).alias(c) for c in df.columns])
    return row.unpivot([], row.columns, "column_name", out)


def profile_schema(df: DataFrame) -> DataFrame:
    """Type and non-null count of every column."""
    types = F.create_map(*[
        x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))
    ])
    counts = _per_column(df, F.count, "non_null")
    return counts.select("column_name", types[F.col("column_name")].alias("dtype"), "non_null")


def column_values(df: DataFrame) -> DataFrame:
    """(column_name, value, n): every column's values as text with their counts.
    One map-side-combined pass; a frequent value is one row per task."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return text.unpivot([], df.columns, "column_name", "value").groupBy(
        "column_name", "value"
    ).agg(F.count(F.lit(1)).alias("n"))


def profile_nunique(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column, fewest first."""
    if approx:
        counts = _per_column(df, F.approx_count_distinct, "n_unique")
    else:
        counts = column_values(df).groupBy("column_name").agg(F.count("value").alias("n_unique"))
    return counts.orderBy("n_unique", "column_name")


def profile_describe(df: DataFrame) -> DataFrame:
    """One row per column; NaN counts as missing. Text columns have unique, top (the smallest of ties)
    and freq; numeric ones have mean, std, quartiles and extremes."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    textual = [c for c in df.columns if c not in numeric]

    def cell(c: str) -> Column:
        value = without_nan(F.col(c)) if c in numeric else F.lit(None).cast("double")
        return F.struct(
            F.lit(c).alias("column_name"), F.count(value if c in numeric else c).alias("count"),
            F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"), F.max(value).alias("max"),
        )

    moments = df.agg(F.array(*[cell(c) for c in df.columns]).alias("cells")).select(
        F.inline("cells")
    )
    # A table without text has no values to count.
    values = column_values(df.select(*(textual or [F.lit(None).alias("")]))).where(F.col("value").isNotNull())
    frequency = values.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("n")).alias("minus"), "value")).alias("best"),
    ).select("column_name", "unique", F.col("best.value").alias("top"),
             (-F.col("best.minus")).alias("freq"))
    quartiles = exact_percentiles(
        df if numeric else df.select(F.lit(None).cast("double").alias("")), numeric or [""],
        [0.25, 0.5, 0.75], names=["p25", "p50", "p75"]
    ).withColumnRenamed("metric", "column_name")
    return moments.join(frequency, "column_name", "left").join(
        quartiles, "column_name", "left"
    ).select("column_name", "count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50",
             "p75", "max")
