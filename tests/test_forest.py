import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tenura.ml import forest, validation
from tenura.sources.shared import pin


def sample(n=300, features=7, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, features))
    x[:, 2] = rng.integers(0, 2, n)
    x[:, 3] = 1.5
    x[:, 4] = np.round(x[:, 4], 1)
    y = ((x[:, 0] + x[:, 2] + rng.normal(size=n) * 0.5) > 0.5).astype(int)
    return x, y


def plain_tree(x, y, w, growth, variant, path, depth=0, edges=None):
    """The tree by recursion over rows, one split at a time, on the same draws."""
    w0 = sum(float(a) for a, b in zip(w, y) if b == 0) * variant[1]
    w1 = sum(float(a) for a, b in zip(w, y) if b == 1) * variant[2]
    node = {"node": int(path), "depth": depth, "feature": -1, "threshold": None, "n": len(y), "w0": w0, "w1": w1}
    if w0 == 0 or w1 == 0 or len(y) < 2 * variant[0] or (growth.depth is not None and depth >= growth.depth):
        return [node]
    order = forest.feature_order(np.array([path], np.uint64), x.shape[1])[0].tolist()
    best = None
    for begin in range(0, len(order), growth.tried):
        for place, f in enumerate(order[begin:begin + growth.tried]):
            if growth.random_cuts:
                limits = [float(forest.random_thresholds(np.array([path], np.uint64), np.array([[f]]),
                                                         x[:, f].min()[None, None], x[:, f].max()[None, None])[0, 0])]
            else:
                limits = edges[f].tolist()
            for limit in limits:
                left = x[:, f] <= limit
                if min(left.sum(), (~left).sum()) < variant[0]:
                    continue
                gain = 0.0
                for side in (left, ~left):
                    a, b = (w[side] * (1 - y[side])).sum() * variant[1], (w[side] * y[side]).sum() * variant[2]
                    gain += (a * a + b * b) / (a + b)
                if best is None or gain > best[0]:
                    best = (gain, f, limit, left)
        if best:
            break
    if not best:
        return [node]
    _, f, limit, left = best
    node["feature"], node["threshold"] = f, limit
    below = []
    for side, use in ((0, left), (1, ~left)):
        below += plain_tree(x[use], y[use], w[use], growth, variant, forest.child(np.uint64(path), side), depth + 1, edges)
    return [node, *below]


def as_rows(spark, x, y):
    data = [(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id bigint, label int, v array<double>").repartition(3)
    return df.select("id", F.col("label").cast("double").alias("label"), array_to_vector("v").alias("features"))


def table_of(nodes):
    rows = nodes.collect()
    return {(r.variant, r.tree, r.node): tuple(None if isinstance(v, float) and v != v else v for v in r[3:]) for r in rows}


@pytest.mark.parametrize("random_cuts", [True, False])
def test_trees_equal_a_plain_grower(spark, random_cuts):
    x, y = sample()
    growth = forest.Growth(3, 2, random_cuts, not random_cuts, None, ((1, 1.0, 1.0), (4, 1.0, 3.0)))
    df = as_rows(spark, x, y)
    rows, edges = pin(forest.feature_rows(df, "id"), "test-rows"), []
    if not random_cuts:
        edges = forest.bin_edges(df)
        rows = pin(forest.coded(rows, edges), "test-coded")
    got = table_of(forest.grow_forest(rows, growth, len(y), x.shape[1], edges))
    for number, variant in enumerate(growth.variants):
        for tree in range(3):
            root = forest.root_of(tree, growth.seed)
            w = forest._sample(growth, np.arange(len(y)), int(root))
            use = w > 0
            expected = plain_tree(x[use], y[use], w[use], growth, variant, root, edges=edges)
            found = {k[2]: v for k, v in got.items() if k[:2] == (number, tree)}
            assert len(found) == len(expected) > 20
            for node in expected:
                signed = node["node"] - 2**64 if node["node"] >= 2**63 else node["node"]
                depth, feature, threshold, n, w0, w1 = found[signed]
                assert (depth, feature, n, w0, w1) == (node["depth"], node["feature"], node["n"], node["w0"], node["w1"])
                assert threshold == node["threshold"] or threshold == pytest.approx(node["threshold"], abs=0)


@pytest.mark.parametrize("random_cuts", [True, False])
def test_passes_over_all_rows_give_the_same_trees(spark, monkeypatch, random_cuts):
    x, y = sample(400)
    growth = forest.Growth(2, 2, random_cuts, not random_cuts, None, ((1, 1.0, 1.0), (3, 1.0, 2.0)))
    df = as_rows(spark, x, y)
    rows, edges = pin(forest.feature_rows(df, "id"), "test-rows"), []
    if not random_cuts:
        edges = forest.bin_edges(df)
        rows = pin(forest.coded(rows, edges), "test-coded")
    whole = table_of(forest.grow_forest(rows, growth, len(y), x.shape[1], edges))
    monkeypatch.setattr(forest, "LOCAL_ROWS", 60)
    monkeypatch.setattr(forest, "TOP_NODES", 40)  # one tree at a time
    assert table_of(forest.grow_forest(rows, growth, len(y), x.shape[1], edges)) == whole


def test_cutting_a_deep_forest_equals_fitting_a_strict_one(spark):
    x, y = sample(500)
    df = as_rows(spark, x, y)
    edges = forest.bin_edges(df)
    rows = pin(forest.coded(forest.feature_rows(df, "id"), edges), "test-coded")
    held = pin(forest.feature_rows(as_rows(spark, *sample(120, seed=9)), "id"), "test-held")
    cuts = [forest.Pruned(3, 2, 2), forest.Pruned(5, 4, 2), forest.Pruned(5, None, 40), forest.Pruned(4, 3, 25)]
    growth = forest.Growth(5, 2, False, True)
    deep = forest.grow_forest(rows, growth, len(y), x.shape[1], edges)
    got = {r.row: r.scores for r in forest.forest_scores(deep, held, 120, 5, cuts).collect()}
    for i, cut in enumerate(cuts):
        strict = forest.grow_forest(rows, forest.Growth(cut.trees, 2, False, True, cut.depth), len(y), x.shape[1], edges)
        if cut.split > 2:  # no split of a node with fewer rows
            strict = strict.withColumn("feature", F.when(F.col("n") < cut.split, -1).otherwise(F.col("feature")))
        own = forest.forest_scores(strict, held, 120, cut.trees, [forest.Pruned(cut.trees)])
        assert {r.row: r.scores[0] for r in own.collect()} == pytest.approx({k: v[i] for k, v in got.items()}, abs=1e-11)


def test_extra_trees_have_free_thresholds_and_any_depth(spark):
    n = 400
    x = np.arange(n, dtype=float)[:, None]
    y = np.arange(n) % 2  # only single rows are pure
    model = forest.ExtraTrees(trees=2).fit(as_rows(spark, x, y))
    nodes = model.nodes.collect()
    assert {r.n for r in nodes if r.feature < 0} == {1} and len(nodes) == 2 * (2 * n - 1)
    assert all(r.threshold % 1 for r in nodes if r.feature >= 0 and r.n > 3)
    scored = model.transform(as_rows(spark, x, y)).select("label", "prediction").collect()
    assert len(scored) == n and all(r.label == r.prediction for r in scored)
    chain = 10.0 ** np.arange(120)[:, None]  # random cuts peel the largest off
    depth = forest.ExtraTrees(trees=1).fit(as_rows(spark, chain, np.arange(120) % 2)).nodes.agg(F.max("depth")).first()[0]
    assert depth > 30


def test_scores_are_shares_of_leaves(spark):
    x, y = sample()
    model = forest.ExtraTrees(trees=4, depth=3).fit(as_rows(spark, x, y))
    trees = [t for _, _, t in forest.trees_of(model.nodes.toArrow())]
    expected = np.mean([t.share[t.leaves(x)] for t in trees], axis=0)
    rows = model.transform(as_rows(spark, x, y)).collect()
    assert {r.id: r.probability[1] for r in rows} == pytest.approx(dict(enumerate(expected)), abs=1e-11)


def test_blocks_and_lots_give_the_same_scores(spark, monkeypatch):
    x, y = sample()
    model = forest.ExtraTrees(trees=7, depth=4).fit(as_rows(spark, x, y))
    held = pin(forest.feature_rows(as_rows(spark, x, y), "id"), "test-held")
    cuts = [forest.Pruned(7), forest.Pruned(3, 2)]
    one = {r.row: r.scores for r in forest.forest_scores(model.nodes, held, len(y), 7, cuts).collect()}
    monkeypatch.setattr(forest, "TREE_LOT", 2)
    monkeypatch.setattr(forest, "ROW_BLOCK", 50)
    many = {r.row: r.scores for r in forest.forest_scores(model.nodes, held, len(y), 7, cuts).collect()}
    assert many.keys() == one.keys() and all(many[k] == pytest.approx(one[k], abs=1e-11) for k in one)


def test_one_class_and_constant_features(spark):
    x = np.ones((20, 3))
    for y in (np.zeros(20, int), np.arange(20) % 2):
        nodes = forest.ExtraTrees(trees=2).fit(as_rows(spark, x, y)).nodes.collect()
        assert len(nodes) == 2 and {r.feature for r in nodes} == {-1}


def test_full_grid_has_every_setting(features):
    grid = {**validation.FOREST_GRID, "trees": [2, 4]}
    rows = validation.rf_grid_search(features, grid, folds=2).collect()
    assert len(rows) == 144 == len({r[:5] for r in rows})
    assert rows[0].roc_auc == max(r.roc_auc for r in rows) > 0.6


def test_rows_travel_packed_and_exact(spark):
    x, _ = sample(50)
    x[:, 5] = np.where(np.arange(50) % 3, -0.25, 7.5)
    head, data = forest.packed(x)
    assert np.array_equal(forest.unpacked(head, data[9:20].tobytes(), 11), x[9:20])
    assert data.shape[1] == 1 + 8 * 4  # three columns of at most two values are bits
    codes = np.arange(24, dtype=np.uint8).reshape(4, 6)
    head, data = forest.packed(codes)
    assert head == b"" and np.array_equal(forest.unpacked(head, data.tobytes(), 4), codes)


def test_dealt_rows_of_a_node_share_a_record(spark):
    x, y = sample(300)
    rows = pin(forest.feature_rows(as_rows(spark, x, y).coalesce(1), "id"), "test-rows")
    growth = forest.Growth(3, 2, True, False)
    tops, _ = forest._split_top(rows, growth, growth.variants[0], range(3), 300, 7, [])
    dealt = forest._dealt(rows, growth, tops).collect()
    assert [(r.tree, len(r.labels)) for r in dealt] == [(0, 300), (1, 300), (2, 300)]


def test_lots_hold_a_bounded_number_of_nodes(spark, monkeypatch):
    x, y = sample()
    model = forest.ExtraTrees(trees=6).fit(as_rows(spark, x, y))
    held = pin(forest.feature_rows(as_rows(spark, x, y), "id"), "test-held")
    one = {r.row: r.scores for r in forest.forest_scores(model.nodes, held, len(y), 6, [forest.Pruned(6)]).collect()}
    monkeypatch.setattr(forest, "LOT_NODES", model.nodes.count() // 3)
    many = {r.row: r.scores for r in forest.forest_scores(model.nodes, held, len(y), 6, [forest.Pruned(6)]).collect()}
    assert many == one
