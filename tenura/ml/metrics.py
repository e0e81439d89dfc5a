"""Classification metrics as aggregations over predictions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.operators.hypothesis import mann_whitney
from tenura.schema import TARGET_FLAG


def _ratio(a, b):
    """a / b, or 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def roc_auc(predictions: DataFrame, label: str = TARGET_FLAG) -> DataFrame:
    """Exact area under the ROC curve, as U / (n1 n0) of the scores."""
    scores = predictions.select(label, vector_to_array("probability")[1].alias("score"))
    u = mann_whitney(scores, ["score"], label, p_value=False)
    return u.select((F.col("U") / (F.col("n1") * F.col("n0").cast("double"))).alias("roc_auc"))


def classification_metrics(predictions: DataFrame, model: str, label: str = TARGET_FLAG
                           ) -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1, and the area."""
    actual, predicted = F.col(label) == 1, F.col("prediction") == 1
    cells = predictions.agg(
        F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    scores = cells.select(
        F.lit(model).alias("model"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    # Both sides are single rows.
    return scores.withColumn("_one", F.lit(1)).join(
        roc_auc(predictions, label).withColumn("_one", F.lit(1)), "_one"
    ).drop("_one")


def confusion_matrix(predictions: DataFrame, label: str = TARGET_FLAG) -> DataFrame:
    return predictions.groupBy(
        F.col(label).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def classification_report(predictions: DataFrame, label: str = TARGET_FLAG) -> DataFrame:
    """Per-class rows, then accuracy, macro and weighted averages."""
    cells = confusion_matrix(predictions, label)
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("called")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("called")),
    )
    hit = F.when((F.col("actual") == F.col("predicted")), F.col("n")).otherwise(0)
    counted = cells.select(F.inline(sides), (hit / 2).alias("half_hit")).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"),
        F.sum("half_hit").alias("hit"),
    )
    per_class = counted.select(
        F.col("class").cast("string").alias("label"),
        _ratio(F.col("hit"), F.col("called")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("called") + F.col("support")).alias("f1"),
        "support", "hit",
    )
    scores = ["precision", "recall", "f1"]
    support = F.sum("support").alias("support")
    accuracy = F.sum("hit") / F.sum("support")
    averages = per_class.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(s) for s in scores],
                     support),
            F.struct(F.lit("macro avg").alias("label"), *[F.avg(s).alias(s) for s in scores],
                     support),
            F.struct(
                F.lit("weighted avg").alias("label"),
                *[(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s)
                  for s in scores], support,
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_class.drop("hit").unionByName(averages)
