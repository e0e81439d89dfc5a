import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tenura.ml import level_forest, metrics, models
from tenura.ml.forest import bin_edges, bootstrap, child, feature_order, root_of
from tenura.ml.level_forest import LevelForest

SEED = 7


@pytest.fixture(scope="module")
def rows(spark):
    """Label, features (one of them constant, two of two values) and a key."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6)).round(1)
    x[:, 1], x[:, 2], x[:, 3] = 4.0, x[:, 2] > 0, x[:, 3] > 1
    y = (x[:, 0] + x[:, 2] + rng.normal(size=len(x)) > 0.8).astype(float)
    data = [(float(b), a.tolist(), i) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "label double, v array<double>, id int")
    return df.select("label", array_to_vector("v").alias("features"), "id").repartition(3, "id").persist()


def plain_tree(x, y, numbers, root, depth, places):
    """One tree a node at a time: {heap place: (feature, cut) or None, class weights}."""
    weights, out = bootstrap(numbers, root), {}

    def grow(node, path, level, at):
        w1, w0 = (float((weights[at] * (y[at] == k)).sum()) for k in (1, 0))
        best = None
        for f in feature_order(np.array([path], np.uint64), x.shape[1])[0][:places] if level < depth and w0 and w1 else []:
            for cut in range(31):
                left = at[x[at, f] <= cut]
                l1, l0 = (float((weights[left] * (y[left] == k)).sum()) for k in (1, 0))
                r0, r1 = w0 - l0, w1 - l1
                if l0 + l1 and r0 + r1:
                    gain = (l0**2 + l1**2) / (l0 + l1) + (r0**2 + r1**2) / (r0 + r1) - (w0**2 + w1**2) / (w0 + w1)
                    if gain > 1e-12 * (w0 + w1) and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, cut
        if best is None:
            out[node] = None, w0, w1
            return
        _, f, cut = best
        for side in (0, 1):
            some = at[(x[at, f] > cut) == side]
            grow(2 * node + 1 + side, child(np.array([path], np.uint64), side)[0], level + 1, some)
        a, b = out[2 * node + 1], out[2 * node + 2]
        same = a[0] is None and b[0] is None and (a[2] > a[1]) == (b[2] > b[1])
        out[node] = None if same else (int(f), cut), w0, w1
        if same:
            del out[2 * node + 1], out[2 * node + 2]

    grow(0, root, 0, np.flatnonzero(weights))
    return out


def reached(trees, i):
    out, todo = {}, [0]
    while todo:
        node = todo.pop()
        f = int(trees.feature[i, node])
        out[node] = (f, int(trees.cut[i, node])) if f >= 0 else None, trees.w0[i, node], trees.w1[i, node]
        todo += [2 * node + 1, 2 * node + 2] if f >= 0 else []
    return out


@pytest.mark.parametrize("block, stretch, heap", [(1 << 15, 64, 1 << 20), (200, 3, 1 << 7)])
def test_trees_are_those_grown_a_node_at_a_time(rows, monkeypatch, block, stretch, heap):
    for name, value in (("BLOCK_ROWS", block), ("STRETCH", stretch), ("HEAP_NODES", heap)):
        monkeypatch.setattr(level_forest, name, value)
    model = LevelForest(5, 6, SEED).fit(rows)
    edges = bin_edges(rows)
    held = rows.select("label", vector_to_array("features").alias("v"), F.monotonically_increasing_id().alias("n")).collect()
    x = np.array([r.v for r in held])
    codes = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1)
    y, numbers = np.array([r.label for r in held]), np.array([r.n for r in held])
    found = [reached(lot, i) for lot in model.grown for i in range(len(lot.feature))]
    plain = [plain_tree(codes, y, numbers, root_of(t, SEED), 6, 3) for t in range(5)]
    assert found == plain and max(len(t) for t in plain) > 20
    shares = np.zeros(len(x))
    for tree in plain:
        for i, row in enumerate(codes):
            node = 0
            while tree[node][0] is not None:
                node = 2 * node + 1 + int(row[tree[node][0][0]] > tree[node][0][1])
            shares[i] += tree[node][2] / (tree[node][1] + tree[node][2]) / 5
    got = model.transform(rows).select(vector_to_array("probability").alias("p"), "prediction").collect()
    assert np.allclose([r.p[1] for r in got], shares) and [r.prediction for r in got] == (shares > 0.5).tolist()


def test_many_rows_take_passes_of_all_trees(rows, monkeypatch):
    assert isinstance(models.random_forest(models.SPARK_ROWS + 1), LevelForest)
    assert isinstance(models.random_forest(models.SPARK_ROWS), RandomForestClassifier)
    assert isinstance(models.random_forest(models.SPARK_ROWS + 1, depth=25), RandomForestClassifier)
    monkeypatch.setattr(models, "SPARK_ROWS", 2000)
    train, test = rows.where("id % 5 > 0"), rows.where("id % 5 = 0").withColumn("label", F.col("label").cast("int"))
    areas = [metrics.classification_metrics(models.random_forest(n, 40, 6).fit(train).transform(test), "forest", label="label")
             .first().roc_auc for n in (2000, 2400)]
    assert areas[0] > 0.8 and areas[1] == pytest.approx(areas[0], abs=0.02)


def test_edges(spark, rows):
    one = rows.withColumn("label", F.lit(1.0))
    got = LevelForest(3, 4).fit(one).transform(one.limit(2)).select("prediction", vector_to_array("probability").alias("p")).collect()
    assert [(r.prediction, r.p) for r in got] == [(1.0, [0.0, 1.0])] * 2
    for label in (2.0, None):
        with pytest.raises(Exception, match="labels must be 0 or 1"):
            LevelForest(3, 4).fit(rows.withColumn("label", F.lit(label).cast("double")))
    with pytest.raises(ValueError):
        LevelForest(3, 17)
