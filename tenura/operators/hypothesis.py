"""Welch, Mann-Whitney and chi-square tests of churned against retained."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions.columns import without_nan
from tenura.functions.special import chi_square_p_value, rank_sum_p_value, t_p_value
from tenura.operators.ranking import average_rank, running_counts
from tenura.schema import CHI_SQUARE_DIMS, TARGET_FLAG, TEST_FEATURES

EXACT_ROWS, EXACT_PAIRS = 8, 100_000

def welch_t(df: DataFrame, features: Sequence[str] = TEST_FEATURES, flag: str = TARGET_FLAG,
            p_value: bool = True) -> DataFrame:
    """Unequal-variance t test; the first sample is the churned one. All
    features come from a single aggregation. NaN counts as missing."""
    cells = []
    for f in features:
        def of(k, f=f):
            return F.when(F.col(flag) == k, without_nan(F.col(f)))
        cells.append(F.struct(
            F.lit(f).alias("feature"),
            *[a for k in (1, 0) for a in (
                F.count(of(k)).alias(f"n{k}"), F.avg(of(k)).alias(f"mean{k}"),
                F.var_samp(of(k)).alias(f"var{k}"),
            )],
        ))
    samples = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    result = samples.withColumns({
        "e1": F.col("var1") / F.col("n1"), "e0": F.col("var0") / F.col("n0"),
    }).select(
        "feature", "n1", "n0", "mean1", "mean0",
        F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt(F.col("e1") + F.col("e0")))
        .alias("t_statistic"),
        F.try_divide(
            F.pow(F.col("e1") + F.col("e0"), 2),
            F.pow("e1", F.lit(2)) / (F.col("n1") - 1) + F.pow("e0", F.lit(2)) / (F.col("n0") - 1),
        ).alias("df"),
    )
    if p_value:
        result = result.withColumn("p_value", t_p_value()("t_statistic", "df"))
    return result


def mann_whitney(df: DataFrame, features: Sequence[str] = TEST_FEATURES, flag: str = TARGET_FLAG,
                 p_value: bool = True) -> DataFrame:
    """Rank-sum test. The p-value is exact where one sample has at most EXACT_ROWS
    rows, no values tie and the product of the sizes is at most EXACT_PAIRS; else it is
    the normal one with tie and continuity correction, whose ``z`` is always given.

    NaN counts as missing. Ranks depend only on the counts per distinct value, so rows collapse to
    those before anything is ordered.
    """
    labelled = df.where(F.col(flag).isin(0, 1)).select(
        F.col(flag).alias("_flag"), *[without_nan(F.col(f)).alias(f) for f in features]
    )
    long = labelled.unpivot(["_flag"], list(features), "feature", "value")
    counts = running_counts(long, ["value"], ["feature"], {
        "n": F.count(F.lit(1)), "churned": F.count_if(F.col("_flag") == 1),
    })
    n = F.col("n").cast("double")
    sums = average_rank(counts).groupBy("feature").agg(
        F.sum("churned").alias("n1"),
        F.sum(F.col("n") - F.col("churned")).alias("n0"),
        F.sum(F.col("churned") * F.col("avg_rank")).alias("rank_sum"),
        F.sum(n * n * n - n).alias("ties"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n_all, u1 = n1 + n0, F.col("U")
    larger = F.greatest(u1, n1 * n0 - u1)
    variance = n1 * n0 / 12 * ((n_all + 1) - F.col("ties") / (n_all * (n_all - 1)))
    result = sums.withColumn("U", F.col("rank_sum") - n1 * (n1 + 1) / 2).select(
        "feature", "n1", "n0", "U",
        F.try_divide(larger - n1 * n0 / 2 - 0.5, F.sqrt(variance)).alias("z"),
        ((F.least(n1, n0) <= EXACT_ROWS) & (F.least(n1, n0) > 0) & (n1 * n0 <= EXACT_PAIRS)
         & (F.col("ties") == 0)).alias("_exact"),
    )
    if p_value:
        result = result.withColumn("p_value", rank_sum_p_value()("U", "n1", "n0", "z", "_exact"))
    return result.drop("_exact")


def expected_counts(df: DataFrame, dims: Sequence[str] = CHI_SQUARE_DIMS,
                    flag: str = TARGET_FLAG) -> DataFrame:
    """Observed and expected count of every (dim, value, flag) cell. Null keys
    are left out. Each row is unpivoted once per dimension and collapses to
    cell counts before the shuffle."""
    long = df.where(F.col(flag).isNotNull()).select(
        F.col(flag).cast("int").alias("flag"), *[F.col(d).cast("string").alias(d) for d in dims]
    ).unpivot(["flag"], list(dims), "dim", "value").dropna(subset="value")
    seen = long.groupBy("dim", "value", "flag").agg(F.count(F.lit(1)).alias("n"))
    classes = F.collect_set("flag").over(Window.partitionBy("dim"))     # flags, not rows
    rows = seen.withColumn("classes", classes).groupBy("dim", "value").agg(
        F.map_from_entries(F.collect_list(F.struct("flag", "n"))).alias("by_flag"),
        F.first("classes").alias("classes"),
    )
    cells = rows.select("dim", "value", F.explode("classes").alias("flag"), "by_flag").select(
        "dim", "value", "flag",
        F.coalesce(F.col("by_flag")[F.col("flag")], F.lit(0)).alias("observed"),
    )
    by_row = Window.partitionBy("dim", "value")
    by_class = Window.partitionBy("dim", "flag")
    return cells.withColumns({
        "row_total": F.sum("observed").over(by_row),
        "class_total": F.sum("observed").over(by_class),
        "n_all": F.sum("observed").over(Window.partitionBy("dim")),
    }).withColumn("expected", F.col("row_total") * F.col("class_total").cast("double")
                  / F.col("n_all"))


def chi_square(df: DataFrame, dims: Sequence[str] = CHI_SQUARE_DIMS, flag: str = TARGET_FLAG,
               p_value: bool = True) -> DataFrame:
    """Independence test per dimension, with Yates' correction for 2 x 2."""
    cells = expected_counts(df, dims, flag)
    shape = cells.groupBy("dim").agg(
        F.count_distinct("value").alias("_rows"), F.count_distinct("flag").alias("_classes")
    ).select("dim", ((F.col("_rows") - 1) * (F.col("_classes") - 1)).alias("dof"))
    gap = F.abs(F.col("observed") - F.col("expected"))
    corrected = F.when(F.col("dof") == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    result = cells.join(shape, "dim").groupBy("dim").agg(
        F.sum(corrected * corrected / F.col("expected")).alias("chi2"),
        F.max("dof").alias("dof"),
    )
    if p_value:
        result = result.withColumn("p_value", chi_square_p_value()("chi2", "dof"))
    return result
