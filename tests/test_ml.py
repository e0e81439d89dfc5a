import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.ml import cluster, metrics, models, prep, validation


@pytest.fixture(scope="module")
def planted(spark):
    """A label that follows x1, and a text column that hints at it."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        x1 = rng.gauss(0, 1)
        y = int(x1 + rng.gauss(0, 0.5) > 0.4)
        rows.append((str(i), y, x1, None if i % 50 == 0 else rng.gauss(0, 1), "uv"[y] if i % 3 else "w"))
    return spark.createDataFrame(
        rows, "customerID string, Churn_Flag int, x1 double, x2 double, t string"
    ).persist()


def test_feature_frame_has_no_leak(features):
    frame = prep.ml_feature_frame(features)
    numeric, categorical = prep.feature_types(frame)
    assert (len(numeric), len(categorical)) == (13, 18)
    assert not (set(S.ML_EXCLUDED) - {"customerID", "Churn_Flag"}) & set(frame.columns)


def test_unseen_and_null_values_encode_to_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    test = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    from pyspark.ml import Pipeline
    out = Pipeline(stages=prep.one_hot(["c"])).fit(train).transform(test)
    got = [list(r[0]) for r in out.select(vector_to_array("c_onehot")).collect()]
    assert got == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0]]


def test_preprocessing_is_fitted_on_train_only(spark, planted):
    model = prep.Preprocessor(["x1", "x2"], ["t"]).fit(planted)
    pdf = planted.toPandas()
    assert model.medians["x2"] == pytest.approx(pdf.x2.median())
    filled = pdf.x2.fillna(pdf.x2.median())
    assert model.scales["x2"] == pytest.approx((filled.mean(), filled.std(ddof=0)))
    far = planted.limit(3).withColumn("x1", F.lit(1e6))
    assert model.transform(far).columns == [*planted.columns, "features"]


@pytest.mark.parametrize("parts", [1, 6])
def test_split_is_exact_disjoint_and_stable(features, parts):
    frame = prep.ml_feature_frame(features).repartition(parts)
    train, test = prep.stratified_split(frame)
    n = {r[0]: r[1] for r in frame.groupBy("Churn_Flag").count().collect()}
    got = {r[0]: r[1] for r in test.groupBy("Churn_Flag").count().collect()}
    assert got == {k: round(v * 0.2) for k, v in n.items()}
    assert train.count() + test.count() == frame.count()
    assert train.join(test, "customerID", "left_semi").isEmpty()
    again = prep.stratified_split(prep.ml_feature_frame(features))[1]
    assert again.select("customerID").exceptAll(test.select("customerID")).isEmpty()


def test_small_classes_lose_no_row(spark):
    rows = [(f"a{i}", 0) for i in range(50)] + [("b1", 1), ("b2", 1), ("c", 2), ("n", None)] + [(f"d{i}", 3) for i in range(3)]
    df = spark.createDataFrame(rows, "customerID string, Churn_Flag int")
    train, test = prep.stratified_split(df)
    assert train.count() + test.count() == len(rows) and test.where("Churn_Flag = 0").count() == 10
    assert test.where("Churn_Flag = 3").count() == 1 and train.where("Churn_Flag IS NULL").count() == 1
    folds = prep.stratified_folds(df, 5).collect()
    assert {r.fold for r in folds} == set(range(5)) and len(folds) == len(rows)
    empty = prep.stratified_split(df.limit(0))
    assert [part.count() for part in empty] == [0, 0]


def test_layout_does_not_depend_on_the_pieces(planted):
    layouts = [prep.spread(planted.repartition(n), "customerID", 5).withColumn("p", F.spark_partition_id()) for n in (1, 7)]
    assert layouts[0].collect() == layouts[1].collect()


def test_folds_are_stratified_within_one_row(features):
    rows = prep.stratified_folds(features, 5).groupBy("Churn_Flag", "fold").count().collect()
    for k in (0, 1):
        sizes = [r["count"] for r in rows if r.Churn_Flag == k]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("name, parameters", [
    ("logistic_regression", {}), ("decision_tree", {}), ("random_forest", {"trees": 10}),
    ("gradient_boosting", {"rounds": 5}), ("extra_trees", {"trees": 10, "depth": 8}),
])
def test_models_find_a_planted_signal(planted, name, parameters):
    train, test = prep.stratified_split(planted)
    predictions = models.fit_predict(models.MODELS[name], train, test, **parameters).persist()
    row = metrics.classification_metrics(predictions, name).first()
    assert row.roc_auc > 0.8 and 0 <= row.precision <= 1
    area = BinaryClassificationEvaluator(
        labelCol="Churn_Flag", rawPredictionCol="probability", numBins=0).evaluate(
            predictions.withColumn("Churn_Flag", F.col("Churn_Flag").cast("double")))
    assert row.roc_auc == pytest.approx(area)
    assert metrics.confusion_matrix(predictions).agg(F.sum("n")).first()[0] == test.count()


def test_metrics_of_known_predictions(spark):
    rows = [(1, 1.0)] * 3 + [(1, 0.0)] * 2 + [(0, 0.0)] * 4 + [(0, 1.0)]
    df = spark.createDataFrame(rows, "Churn_Flag int, prediction double")
    rows = {r.label: r for r in metrics.classification_report(df).collect()}
    assert rows["1"].precision == 0.75 and rows["1"].recall == 0.6 and rows["1"].support == 5
    assert rows["accuracy"].f1 == 0.7
    assert rows["macro avg"].recall == pytest.approx((0.6 + 0.8) / 2)
    assert rows["weighted avg"].precision == pytest.approx((0.75 * 5 + 4 / 6 * 5) / 10)


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0)], "Churn_Flag int, prediction double")
    row = {r.label: r for r in metrics.classification_report(df).collect()}["1"]
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_cross_validation(spark, features):
    rows = validation.stratified_cv(features, "decision_tree", folds=2).collect()
    assert [r.fold for r in rows] == ["1", "2", "mean"]
    assert rows[2].accuracy == pytest.approx((rows[0].accuracy + rows[1].accuracy) / 2)


def test_grid_search(features):
    grid = {"trees": [3], "depth": [2, 3], "min_split": [2], "min_leaf": [1], "class_weight": [None, "balanced"]}
    rows = validation.rf_grid_search(features, grid, folds=2).collect()
    assert len(rows) == 4 and rows[0].roc_auc == max(r.roc_auc for r in rows)
    assert [len(v) for v in validation.FOREST_GRID.values()] == [2, 4, 3, 3, 2]


def test_clusters_recover_groups(spark):
    rng = random.Random(5)
    centers = [(0, 0), (10, 10), (20, 0)]
    rows = [(str(i), i % 3, centers[i % 3][0] + rng.gauss(0, 0.3), centers[i % 3][1] + rng.gauss(0, 0.3))
            for i in range(150)]
    df = spark.createDataFrame(rows, "customerID string, truth int, a double, b double")
    out = cluster.kmeans_assign(df, 3, starts=3, features=["a", "b"])
    pairs = out.groupBy("truth", "Customer_Cluster").count().collect()
    assert sorted((r.truth, r.Customer_Cluster) for r in pairs) == [(0, 0), (1, 1), (2, 2)]
    sweep = cluster.kmeans_sweep(df, [2, 3], starts=2, features=["a", "b"]).collect()
    assert sweep[1].inertia < sweep[0].inertia and sweep[1].silhouette > 0.95


def test_all_fits_share_passes_and_equal_sparks_own(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2)) + rng.integers(0, 4, 300)[:, None] * [6.0, -3.0]
    df = spark.createDataFrame([(a.tolist(),) for a in x], "v array<double>").select(
        array_to_vector("v").alias("features")).repartition(3).persist()
    calls, plain = [], cluster.map_batches
    monkeypatch.setattr(cluster, "map_batches", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(cluster, "POINTS_AT_ONCE", 37)
    found = cluster.best_kmeans(df, [2, 5], starts=3, seed=7)
    passes = []
    for k, got in zip([2, 5], found):
        fits = [KMeans(k=k, seed=7 + i, maxIter=300).fit(df) for i in range(3)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        passes += [m.summary.numIter for m in fits]
        assert got.cost == pytest.approx(best.summary.trainingCost) and got.passes == best.summary.numIter
        assert got.centers == pytest.approx(np.array(best.clusterCenters()))
        pairs = {(tuple(r.features), r.prediction) for r in got.assign(df).collect()}
        assert pairs == {(tuple(r.features), r.prediction) for r in best.transform(df).select("features", "prediction").collect()}
    assert len(calls) == 1 + max(passes)     # the blocks, and a step for all fits together


def test_fewer_distinct_points_than_clusters(spark):
    df = spark.createDataFrame([(str(i), float(i % 2), 1.0) for i in range(20)], "customerID string, a double, b double")
    out = cluster.kmeans_assign(df, 4, starts=2, features=["a", "b"])
    assert {(r.a, r.Customer_Cluster) for r in out.collect()} == {(0.0, 0), (1.0, 1)}


def test_components_equal_numpy(features):
    pdf = features.select("customerID", *S.CLUSTER_FEATURES).toPandas().set_index("customerID")
    x = pdf.astype(float)
    x = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    shares = s ** 2 / (s ** 2).sum()
    rows = cluster.pca_variance(features).collect()
    assert [r.explained for r in rows] == pytest.approx(shares[:2].tolist())
    assert rows[1].cumulative == pytest.approx(shares[:2].sum())
    got = cluster.pca_project(features).toPandas().set_index("customerID").loc[pdf.index]
    for i in (0, 1):
        v = vt[i] * np.sign(vt[i][np.abs(vt[i]).argmax()])
        assert np.allclose(got[f"PCA{i + 1}"], x @ v, atol=1e-8)


def test_cluster_inputs_are_median_filled(spark):
    df = spark.createDataFrame([("1", 1.0), ("2", None), ("3", 3.0), ("4", 8.0)], "customerID string, a double")
    values = [r[0][0] for r in cluster.cluster_vectors(df, ["a"], ["customerID"]).orderBy(
        "customerID").select(vector_to_array("features")).collect()]
    filled = np.array([1.0, 3.0, 3.0, 8.0])
    assert values == pytest.approx(((filled - filled.mean()) / filled.std()).tolist())
