import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression

from tenura.ml import boosting, forest, reweighted
from tenura.sources.shared import pin
from tests.test_forest import as_rows, sample


def plain_rounds(codes, y, rounds, depth, step):
    """Boosting with numpy over all rows, a node at a time."""
    p0 = y.mean()
    score = np.full(len(y), np.log(p0 / (1 - p0)))
    base, values, losses = score.copy(), [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        losses.append(-np.mean(np.log(np.where(y == 1, p, 1 - p))))
        r, h = y - p, p * (1 - p)
        leaves, nodes = {}, [(0, np.arange(len(y)))]
        for level in range(depth + 1):
            below = []
            for number, rows in nodes:
                best = None
                for f in range(codes.shape[1]) if level < depth else []:
                    for cut in range(forest.BINS - 1):
                        left = codes[rows, f] <= cut
                        a, b = left.sum(), (~left).sum()
                        if a and b:
                            gain = (r[rows][left].mean() - r[rows][~left].mean()) ** 2 * a * b / (a + b)
                            if best is None or gain > best[0] + 1e-12:
                                best = (gain, f, cut, left)
                if best is None:
                    leaves[number] = (r[rows].sum() / h[rows].sum(), rows)
                else:
                    below += [(2 * number + 1, rows[best[3]]), (2 * number + 2, rows[~best[3]])]
            nodes = below
        values.append({k: v for k, (v, _) in leaves.items()})
        for v, rows in leaves.values():
            score[rows] += step * v
    return base, values, losses, 1 / (1 + np.exp(-score))


@pytest.mark.parametrize("local_rows", [100, 1000])
def test_rounds_equal_numpy(spark, monkeypatch, local_rows):
    monkeypatch.setattr(boosting, "WRITTEN", 3)
    monkeypatch.setattr(forest, "LOCAL_ROWS", local_rows)
    x, y = sample(240, 5)
    df = as_rows(spark, x, y)
    model = boosting.NewtonBoosting(rounds=7, depth=2, step=0.3).fit(df)
    codes = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(model.edges)], axis=1)
    base, values, losses, shares = plain_rounds(codes, y, 7, 2, 0.3)
    assert model.model.base == pytest.approx(base[0], abs=1e-12)
    for tree, leaves in zip(model.model.trees, values):
        got = {i: tree.value[i] for i in np.unique(tree.reached(codes)).tolist()}
        assert got == pytest.approx(leaves, abs=1e-9)
    assert model.losses == pytest.approx(losses, abs=1e-9)
    rows = model.transform(df).select("id", "probability", "prediction").collect()
    assert {r.id: r.probability[1] for r in rows} == pytest.approx(dict(enumerate(shares)), abs=1e-9)
    assert all(r.prediction == float(r.probability[1] > 0.5) for r in rows)


def test_passes_read_blocks_of_rows(spark, monkeypatch):
    x, y = sample(240, 5)
    df = as_rows(spark, x, y)
    edges = forest.bin_edges(df)
    rows = pin(forest.coded(forest.feature_rows(df, "id"), edges), "test-coded")
    monkeypatch.setattr(forest, "LOCAL_ROWS", 100)
    model = boosting.NewtonBoosting(rounds=3).fit(df).model
    held = boosting._with_scores(boosting._blocks(rows, 0.25), model, 0).toArrow()
    found = [b for part in held.to_batches() for b in boosting._opened([part])]
    assert held.num_rows <= 3 and sum(len(s) for s, *_ in found) == 240
    codes = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1)
    expected = sorted(zip(0.25 + model.scores(codes), y.tolist(), map(tuple, codes.tolist())))
    got = sorted((s, l, tuple(c)) for some in found for s, l, c in zip(some[0], some[1].tolist(), some[2].tolist()))
    assert got == expected


def test_loss_falls_every_round(spark):
    x, y = sample(400, 5)
    losses = boosting.NewtonBoosting(rounds=30).fit(as_rows(spark, x, y)).losses
    assert len(losses) == 30 and all(b < a for a, b in zip(losses, losses[1:]))


def test_constant_features_and_one_class(spark):
    x = np.ones((20, 2))
    model = boosting.NewtonBoosting(rounds=2).fit(as_rows(spark, x, np.arange(20) % 2))
    assert [t.feature[0] for t in model.model.trees] == [-1, -1]
    rows = boosting.NewtonBoosting(rounds=2).fit(as_rows(spark, sample(20)[0], np.ones(20, int)))
    assert rows.transform(as_rows(spark, x.repeat(4, 1)[:, :7], np.ones(20, int))).where("prediction = 1").count() == 20


def numpy_weighted(x, y, penalty, steps=60):
    x = np.hstack([np.ones((len(x), 1)), x])
    beta, ridge = np.zeros(x.shape[1]), penalty * np.diag([0.0, *np.ones(x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
    return beta


def test_coefficients_equal_numpy_and_the_spark_fit(spark):
    x, y = sample(500, 5)
    x = np.delete(x, 3, axis=1)
    df = as_rows(spark, x, y)
    rows = pin(forest.feature_rows(df, "id"), "test-rows")
    fit = reweighted.fit_rows(rows)
    assert fit.coefficients == pytest.approx(numpy_weighted(x, y, 1.0), abs=1e-8)
    assert all(b < a for a, b in zip(fit.losses, fit.losses[1:4]))
    spark_fit = LogisticRegression(maxIter=500, regParam=1 / 500, standardization=False, tol=1e-12).fit(df)
    assert fit.coefficients[0] == pytest.approx(spark_fit.intercept, abs=1e-5)
    assert fit.coefficients[1:] == pytest.approx(spark_fit.coefficients.toArray(), abs=1e-5)


def test_separable_and_repeated_columns_end(spark):
    x = np.linspace(-1, 1, 40)[:, None]
    y = (x[:, 0] > 0).astype(int)
    rows = pin(forest.feature_rows(as_rows(spark, np.hstack([x, x]), y), "id"), "test-rows")
    fit = reweighted.fit_rows(rows)
    assert fit.coefficients[1] == pytest.approx(fit.coefficients[2], abs=1e-8) and fit.change <= 1e-10


def test_missing_values_take_no_part(spark):
    x, y = sample(100)
    data = [(int(b), float(a[0]), float(a[1])) for a, b in zip(x, y)]
    more = [(1, None, 0.0), (None, 0.0, 0.0), (0, float("nan"), 1.0)]
    schema = "Churn_Flag int, a double, b double"
    one, two = (
        [tuple(r) for r in reweighted.reweighted_regression(spark.createDataFrame(d, schema).coalesce(1), ["a", "b"]).collect()]
        for d in (data, data + more))
    assert [r[0] for r in one] == ["intercept", "a", "b"]
    assert [r[1] for r in two] == pytest.approx([r[1] for r in one], abs=1e-9)
    empty = reweighted.reweighted_regression(spark.createDataFrame([], schema), ["a", "b"]).collect()
    assert [r.coefficient for r in empty] == [0.0, 0.0, 0.0]
