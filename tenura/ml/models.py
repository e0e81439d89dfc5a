"""The five classifiers and their evaluation on a stratified split."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.ml.boosting import NewtonBoosting
from tenura.ml.forest import ExtraTrees
from tenura.ml.level_forest import MOST_DEPTH, LevelForest
from tenura.ml.prep import (
    Preprocessor, PreprocessorModel, feature_types, ml_feature_frame, spread, stratified_split,
)
from tenura.schema import RANDOM_SEED, TARGET_FLAG
from tenura.sources.shared import pin

SPARK_ROWS = 1 << 17  # training rows up to which a random forest is Spark's classifier

_COMMON = {"featuresCol": "features", "labelCol": "label"}


def logistic_regression(n_train: int, max_iter: int = 2000):
    """L2 penalty of weight 1 on the summed loss, as a share per training row."""
    return LogisticRegression(maxIter=max_iter, regParam=1.0 / n_train, elasticNetParam=0.0,
                              standardization=False, **_COMMON)


def decision_tree(n_train: int = 0, depth: int = 6):
    return DecisionTreeClassifier(maxDepth=depth, seed=RANDOM_SEED, **_COMMON)


def random_forest(n_train: int = 0, trees: int = 300, depth: int = 10):
    """Spark's classifier; beyond SPARK_ROWS rows, where the time of its passes rises faster
    than the rows, a forest by the same rules with other draws."""
    if n_train > SPARK_ROWS and 1 <= depth <= MOST_DEPTH:
        return LevelForest(trees, depth)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=RANDOM_SEED,
                                  featureSubsetStrategy="sqrt", **_COMMON)


def gradient_boosting(n_train: int = 0, rounds: int = 100, depth: int = 3):
    return NewtonBoosting(rounds, depth, step=0.1)


def extra_trees(n_train: int = 0, trees: int = 300, depth: int | None = None):
    return ExtraTrees(trees, depth)


MODELS: dict[str, Callable] = {
    "logistic_regression": logistic_regression,
    "decision_tree": decision_tree,
    "random_forest": random_forest,
    "gradient_boosting": gradient_boosting,
    "extra_trees": extra_trees,
}


def with_label(df: DataFrame, label: str = TARGET_FLAG) -> DataFrame:
    return df.withColumn("label", F.col(label).cast("double"))


def fit_predict(build: Callable, train: DataFrame, test: DataFrame, key: str = "customerID",
                label: str = TARGET_FLAG, **parameters) -> DataFrame:
    """Fit preprocessing and classifier on ``train``; key, label, prediction and
    probability of every row of ``test``."""
    prep, vectors = training_vectors(train, key, label)
    try:
        model = build(vectors.count(), **parameters).fit(vectors.select("label", "features"))
    finally:
        vectors.unpersist()
    return model.transform(prep.transform(test)).select(key, label, "prediction", "probability")


def training_vectors(train: DataFrame, key: str = "customerID", label: str = TARGET_FLAG,
                     more: Sequence[str] = ()) -> tuple[PreprocessorModel, DataFrame]:
    """The fitted preprocessing and the encoded rows, written once in a layout
    that doesn't depend on the cores, and kept while fits read them again."""
    numeric, categorical = feature_types(train.drop(*more), key, label)
    prep = Preprocessor(numeric, categorical).fit(train)
    encoded = with_label(prep.transform(train), label).select(key, "label", "features", *more)
    return prep, spread(pin(encoded, "vectors"), key).persist(StorageLevel.MEMORY_AND_DISK)


def train_and_predict(df: DataFrame, name: str, **parameters) -> DataFrame:
    """Predictions of a named model on the held-out fifth of the customers."""
    train, test = stratified_split(ml_feature_frame(df))
    return fit_predict(MODELS[name], train, test, **parameters)
