"""Stratified cross-validation and the random-forest grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tenura.ml.forest import Growth, Pruned, bin_edges, coded, feature_rows, grow_pieces, piece_scores
from tenura.ml.metrics import classification_metrics
from tenura.ml.models import MODELS, fit_predict, training_vectors, with_label
from tenura.ml.prep import ml_feature_frame, stratified_folds
from tenura.operators.hypothesis import mann_whitney
from tenura.schema import CUSTOMER_ID
from tenura.sources.shared import pin, shuffles_dropped, unpin

# The grid as fixed values; depth None means until leaves can't be split.
FOREST_GRID = {
    "trees": [100, 200],
    "depth": [5, 8, 12, None],
    "min_split": [2, 5, 10],
    "min_leaf": [1, 2, 4],
    "class_weight": [None, "balanced"],
}


def stratified_cv(df: DataFrame, model: str = "logistic_regression", folds: int = 5,
                  parallelism: int = 4, **parameters) -> DataFrame:
    """Accuracy and area per fold and their means. One fit per fold serves both
    figures; preprocessing is refitted on each training part. Folds run side by
    side, so that small stages of one fill the cores another leaves idle."""
    rows = stratified_folds(ml_feature_frame(df), folds)

    def score(k: int) -> Row:
        train, test = (rows.where(c).drop("fold") for c in (f"fold <> {k}", f"fold = {k}"))
        predictions = fit_predict(MODELS[model], train, test, **parameters)
        return classification_metrics(predictions, model).first()

    with ThreadPool(min(parallelism, folds)) as pool:
        scores = pool.map(inheritable_thread_target(df.sparkSession)(score), range(folds))
    local = df.sparkSession.createDataFrame(
        [(str(k + 1), r["accuracy"], r["roc_auc"]) for k, r in enumerate(scores)],
        "fold string, accuracy double, roc_auc double",
    )
    means = local.agg(F.avg("accuracy").alias("accuracy"), F.avg("roc_auc").alias("roc_auc"))
    return local.unionByName(means.select(F.lit("mean").alias("fold"), "accuracy", "roc_auc"))


def balanced_weights(sizes: Mapping[int, int]) -> tuple[float, float]:
    """Weights of the classes 0 and 1, inverse to their frequency."""
    n = sum(sizes.values())
    return tuple(n / (len(sizes) * sizes[k]) if sizes.get(k) else 1.0 for k in (0, 1))


def rf_grid_search(df: DataFrame, grid: Mapping[str, Sequence] = FOREST_GRID, folds: int = 3) -> DataFrame:
    """Mean cross-validated area per setting, best first.

    Per fold one forest is grown for each leaf size and class weight, as large and
    deep as any setting asks for; number of trees, depth and the rows that a split
    needs are cut from its table of nodes, which gives what fits of their own
    would. All settings are scored in one pass over the held-out rows. A fold's forest and
    scores are deleted after it."""
    rows = stratified_folds(ml_feature_frame(df), folds)
    trees = max(grid["trees"])
    depth = None if None in grid["depth"] else max(grid["depth"])
    kinds = [(leaf, weight is not None) for leaf in grid["min_leaf"] for weight in grid["class_weight"]]
    cuts = [Pruned(t, d, s) for t in grid["trees"] for d in grid["depth"] for s in grid["min_split"]]
    names = {f"v{v}_{i}": (kind, cut) for v, kind in enumerate(kinds) for i, cut in enumerate(cuts)}
    areas = dict.fromkeys(names, 0.0)
    for k in range(folds):
        train, test = (rows.where(c).drop("fold") for c in (f"fold <> {k}", f"fold = {k}"))
        with shuffles_dropped(df.sparkSession):
            found = _areas(train, test, kinds, cuts, trees, depth, list(names))
        for name, area in found.items():
            areas[name] += area / folds
    data = [(c.trees, c.depth, c.split, leaf, balanced, areas[name]) for name, ((leaf, balanced), c) in names.items()]
    return df.sparkSession.createDataFrame(
        data, "trees int, depth int, min_split int, min_leaf int, balanced boolean, roc_auc double"
    ).orderBy(F.col("roc_auc").desc(), "trees", F.col("depth").asc_nulls_last(), "min_split", "min_leaf", "balanced")


def _areas(train: DataFrame, test: DataFrame, kinds: Sequence[tuple[int, bool]], cuts: Sequence[Pruned], trees: int,
           depth: int | None, names: Sequence[str], key: str = CUSTOMER_ID) -> dict[str, float]:
    """Area on ``test`` of every kind of forest and cut, by name."""
    prep, vectors = training_vectors(train, key)
    try:
        edges = bin_edges(vectors)
        coded_rows = pin(coded(feature_rows(vectors, f"xxhash64(`{key}`)"), edges), "grid-rows")
    finally:
        vectors.unpersist()
    sizes = {r.label: r["count"] for r in coded_rows.groupBy("label").count().collect()}     # one per class
    features = len(edges)
    growth = Growth(trees, max(1, int(features**0.5)), False, True, depth,
                    tuple((leaf, *(balanced_weights(sizes) if balanced else (1.0, 1.0))) for leaf, balanced in kinds))
    pieces = grow_pieces(coded_rows, growth, sum(sizes.values()), features, edges, "grid-forest")
    held = with_label(prep.transform(test)).select("label", "features")
    held = pin(feature_rows(held, "monotonically_increasing_id()"), "grid-held")
    scores = piece_scores(pieces, held, held.count(), trees, cuts)
    wide = scores.groupBy("row").agg(*[
        F.max(F.when(F.col("variant") == v, F.col("scores")[i])).alias(f"v{v}_{i}")
        for v in range(len(kinds)) for i in range(len(cuts))
    ])
    wide = pin(wide.join(held.select("row", "label"), "row"), "grid-scores")
    ranks = mann_whitney(wide, names, "label", p_value=False)
    found = {r.feature: r.U / (r.n1 * r.n0) for r in ranks.collect()}     # one per setting
    unpin(coded_rows, pieces, held, wide)
    return found
