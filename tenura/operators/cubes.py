"""The dashboard's cube over keys that repeat, from states of its finest cells.

One pass over the rows gives, per finest cell and range of 32,768 ids, sums and a
bitmap of the ids seen. All levels of the cube and any filter are answered from
this table; distinct customers are exact, as bitmaps of several cells are
united before they are counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import exact_sum, without_nan
from tenura.operators.kpis import SLICERS
from tenura.schema import CUSTOMER_ID, TARGET_FLAG

SUMS = ["flags", "churned", "retained", "charges", "charged"]


def kpi_states(df: DataFrame, slicers: Sequence[str] = SLICERS, key: str = CUSTOMER_ID) -> DataFrame:
    """(slicers, bucket, sums, ids). ``key`` holds whole numbers, dense ones best; a row
    whose key is none counts in the sums, but as no customer."""
    charges, number = without_nan(F.col("MonthlyCharges")), F.col(key).try_cast("bigint")
    return df.withColumn("_id", number).groupBy(*slicers, F.bitmap_bucket_number("_id").alias("bucket")).agg(
        F.count(TARGET_FLAG).alias("flags"), F.sum(F.col(TARGET_FLAG).cast("bigint")).alias("churned"),
        F.count_if(F.col(TARGET_FLAG) == 0).alias("retained"), exact_sum(charges).alias("charges"),
        F.count(charges).alias("charged"), F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("ids"),
    )


def _merged() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in SUMS], F.bitmap_or_agg("ids").alias("ids")]


def _cards(seen: Column) -> list[Column]:
    return [
        (100 - F.try_divide(F.sum("churned"), F.sum("flags")) * 100).alias("retention_rate"),
        F.coalesce(F.sum(seen), F.lit(0)).alias("total_customers"),
        F.coalesce(F.sum("retained"), F.lit(0)).alias("retained_customers"),
        F.try_divide(F.sum("charges"), F.sum("charged")).alias("avg_monthly_charges"),
        F.coalesce(F.sum("charges"), F.lit(0.0)).alias("monthly_revenue"),
    ]


def _seen() -> Column:
    return F.when(F.col("bucket").isNotNull(), F.bitmap_count("ids")).otherwise(0)


def cards_from_states(states: DataFrame, filters: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The five cards for the chosen slicer values."""
    for name, values in (filters or {}).items():
        states = states.where(F.col(name).isin(list(values)))
    return states.groupBy("bucket").agg(*_merged()).agg(*_cards(_seen()))


def cube_from_states(states: DataFrame, slicers: Sequence[str] = SLICERS) -> DataFrame:
    """The cards for every combination of slicers; level 0 is the finest."""
    slicers = list(slicers)
    sets = [[*some, "bucket"] for n in range(len(slicers) + 1) for some in combinations(slicers, n)]
    levels = states.groupingSets([[F.col(c) for c in s] for s in sets], *slicers, "bucket").agg(
        F.shiftright(F.grouping_id(), 1).alias("level"), *_merged())
    return levels.groupBy(*slicers, "level").agg(*_cards(_seen()))
