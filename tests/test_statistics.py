import math
import random
from decimal import Decimal, getcontext

import numpy as np
import pytest

from tenura.functions import special
from tenura.operators import correlation, distribution, hypothesis


def test_published_tail_values():
    # Two-sided t and upper chi-square points of the usual printed tables.
    for t, df, p in [(12.706, 1, 0.05), (2.228, 10, 0.05), (2.750, 30, 0.01), (1.960, 1e9, 0.05)]:
        assert special.t_two_sided(t, df) == pytest.approx(p, rel=2e-3)
    for x, dof, p in [(3.841, 1, 0.05), (5.991, 2, 0.05), (18.307, 10, 0.05), (23.209, 10, 0.01)]:
        assert special.chi_square_upper(x, dof) == pytest.approx(p, rel=2e-3)
    assert special.normal_two_sided(1.959964) == pytest.approx(0.05, rel=1e-5)


def test_tail_identities():
    for x in (0.1, 1.0, 3.0, 20.0):
        assert special.chi_square_upper(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert special.chi_square_upper(x, 1) == pytest.approx(
            math.erfc(math.sqrt(x / 2)), rel=1e-10)
    for t in (0.0, 0.5, 2.0, 30.0):
        assert special.t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9)
    assert special.t_two_sided(2.5, 1e8) == pytest.approx(special.normal_two_sided(2.5), rel=1e-6)


def even_degrees(t, df):
    """The two-sided tail for an even number of degrees, a finite sum."""
    getcontext().prec = 50
    square = Decimal(t) ** 2 / df
    term = total = Decimal(1)
    for i in range(1, df // 2):
        term *= (2 * i - 1) / (Decimal(2 * i) * (1 + square))
        total += term
    return float(1 - (square / (1 + square)).sqrt() * total)


@pytest.mark.parametrize("df", [10, 500, 2998, 3000, 40_000])
def test_t_tail_is_exact(df):
    for t in (0.3, 1.96, 6.0):
        assert special.t_two_sided(t, df) == pytest.approx(even_degrees(t, df), rel=1e-11)


def test_t_tail_at_many_degrees():
    for df in (1e10, 1e12):
        density = math.exp(-1.96**2 / 2) / math.sqrt(2 * math.pi)
        expected = special.normal_two_sided(1.96) + 2 * density * (1.96**3 + 1.96) / (4 * df)
        assert special.t_two_sided(1.96, df) == pytest.approx(expected, rel=1e-14)


def test_no_unconverged_value_is_returned():
    with pytest.raises(ArithmeticError):
        special.beta_tail(0.5, 1e13, 1e13)


def test_many_columns_with_nulls(spark):
    rng = np.random.default_rng(4)
    values = rng.random((60, 70)).round(2)
    rows = [(str(i), *[None if c % 9 == 5 and i % 7 == c % 2 else float(v) for c, v in enumerate(r)]) for i, r in enumerate(values)]
    names = [f"c{i}" for i in range(70)]
    df = spark.createDataFrame(rows, "customerID string, " + ", ".join(f"{n} double" for n in names))
    for method, build, some in (("pearson", correlation.pearson_matrix, names), ("spearman", correlation.spearman_matrix, names[:15])):
        got = build(df, some).toPandas().pivot(index="column_a", columns="column_b", values="correlation").loc[some, some]
        assert np.allclose(got.to_numpy(), df.toPandas()[some].corr(method=method).to_numpy(), atol=1e-12)
    target = correlation.target_correlation(df, names[:15], "c5").collect()
    wanted = df.toPandas()[names].corr(method="spearman")["c5"]
    assert all(r.spearman == pytest.approx(wanted[r.column_name]) for r in target)


def test_welch(features):
    pdf = features.toPandas()
    a, b = (pdf.loc[pdf.Churn_Flag == k, "tenure"] for k in (1, 0))
    row = hypothesis.welch_t(features, ["tenure"]).first()
    se = math.sqrt(a.var() / len(a) + b.var() / len(b))
    assert row.t_statistic == pytest.approx((a.mean() - b.mean()) / se)
    assert 0 <= row.p_value <= 1


def test_mann_whitney_is_the_pair_count(features):
    pdf = features.toPandas()
    row = hypothesis.mann_whitney(features, ["MonthlyCharges"]).first()
    a, b = (pdf.loc[pdf.Churn_Flag == k, "MonthlyCharges"].to_numpy() for k in (1, 0))
    wins = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    assert row.U == wins and row.n1 == len(a) and row.n0 == len(b)


def test_chi_square_two_by_two_uses_yates(spark):
    cells = [("x", 0, 10), ("x", 1, 20), ("y", 0, 30), ("y", 1, 15)]
    df = spark.createDataFrame(
        [(k, f) for k, f, n in cells for _ in range(n)] + [(None, 1)] * 4, "k string, f int"
    )
    row = hypothesis.chi_square(df, ["k"], "f").first()
    assert row.chi2 == pytest.approx(6.752232, abs=1e-6) and row.dof == 1
    assert row.p_value == pytest.approx(math.erfc(math.sqrt(row.chi2 / 2)), rel=1e-9)


def test_chi_square_with_an_empty_cell(spark):
    df = spark.createDataFrame(
        [("a", 0)] * 5 + [("a", 1)] * 3 + [("b", 0)] * 4 + [("c", 0)] * 2 + [("c", 1)] * 6,
        "k string, f int",
    )
    row = hypothesis.chi_square(df, ["k"], "f").first()
    observed = np.array([[5, 3], [4, 0], [2, 6]])
    expected = np.outer(observed.sum(1), observed.sum(0)) / observed.sum()
    assert row.dof == 2
    assert row.chi2 == pytest.approx(((observed - expected) ** 2 / expected).sum())


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_matrices_with_missing_values_equal_pandas(spark, method):
    rng = random.Random(3)
    rows = [
        (str(i), rng.random(), float(rng.randrange(4)), None if rng.random() < 0.2 else rng.gauss(0, 1),
         None if rng.random() < 0.3 else float(rng.randrange(3)))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "customerID string, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    build = {"pearson": correlation.pearson_matrix, "spearman": correlation.spearman_matrix}[method]
    got = build(df, names).toPandas().pivot(
        index="column_a", columns="column_b", values="correlation").loc[names, names]
    want = df.toPandas()[names].corr(method=method)
    assert np.allclose(got.to_numpy(), want.to_numpy(), atol=1e-12)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([("1", 1.0, 5.0), ("2", 2.0, 5.0)], "customerID string, a double, b double")
    rows = {(r[0], r[1]): r[2] for r in correlation.pearson_matrix(df, ["a", "b"]).collect()}
    assert rows["a", "b"] is None


def test_distribution_equals_pandas(features):
    s = features.select("TotalCharges").toPandas()["TotalCharges"]
    row = distribution.distribution_stats(features, ["TotalCharges"]).first()
    assert row["mode"] == s.mode().iloc[0]
    for name, value in {
        "mean": s.mean(), "median": s.median(), "std": s.std(), "variance": s.var(),
        "q1": s.quantile(0.25), "q3": s.quantile(0.75), "range": s.max() - s.min(),
        "skew": s.skew(), "kurtosis": s.kurtosis(),
    }.items():
        assert row[name] == pytest.approx(value, rel=1e-9)


def test_constant_and_tiny_distributions(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, None), (2.0, 3.0)], "c double, t double")
    rows = {r.metric: r for r in distribution.distribution_stats(df, ["c", "t"]).collect()}
    assert rows["c"]["skew"] is None and rows["c"]["std"] == 0.0
    assert rows["t"]["skew"] is None and rows["t"]["kurtosis"] is None


def test_outliers(features):
    pdf = features.toPandas()
    rows = {r.Feature: r for r in distribution.iqr_outliers(features).collect()}
    listed = distribution.outlier_rows(features).groupBy("Feature").count().collect()
    for name, row in rows.items():
        q1, q3 = pdf[name].quantile(0.25), pdf[name].quantile(0.75)
        outside = ((pdf[name] < q1 - 1.5 * (q3 - q1)) | (pdf[name] > q3 + 1.5 * (q3 - q1))).sum()
        assert row.Outlier_Count == outside
        assert sum(r["count"] for r in listed if r.Feature == name) == outside
