"""States that merge, files that survive a retry, lines that are rescued."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.functions.special import rank_sum_counts, rank_sum_two_sided
from tenura.ml import cluster, prep
from tenura.operators import cubes, distribution, hypothesis, kpis, profile, sketches
from tenura.sources import subscribers as source
from tenura.sources import versions


# --- percentiles ---------------------------------------------------------------------

def test_merged_sketches_keep_their_bound(spark):
    n = 60_000
    df = spark.range(n).select((F.hash("id") % 7).alias("day"), F.col("id").cast("double").alias("v"))
    days = sketches.quantile_states(df, ["v"], ["day"], 256)
    probs = [0.01, 0.25, 0.5, 0.9]
    for states in (sketches.merge_states(days), sketches.quantile_states(df, ["v"], size=256)):
        row = sketches.read_quantiles(states, [], probs).first()
        assert row.n == n
        for p, got in zip(probs, row[2:]):
            assert abs(got / n - p) < 3 * sketches.rank_error(256)


def test_small_sketches_are_exact_and_leave_out_what_is_missing(spark):
    df = spark.createDataFrame([("a", float(i), None) for i in range(10)] + [("a", float("nan"), None), ("b", None, None)],
                               "g string, v double, w double")
    rows = sketches.read_quantiles(sketches.quantile_states(df, ["v", "w"], ["g"]), ["g"], [0.1, 0.5, 1.0]).collect()
    assert [tuple(r) for r in rows] == [("a", "v", 10, 0.0, 4.0, 9.0)]


# --- the cube ------------------------------------------------------------------------

def test_cube_of_states_equals_the_direct_cube(spark, features):
    again = features.where(F.col("customerID").cast("int") % 3 == 0).withColumn("Contract", F.lit("Two year"))
    rows = features.unionByName(again).unionByName(again).withColumn(
        "customerID", (F.col("customerID").cast("bigint") * 7919).cast("string"))  # several ranges of ids
    states = cubes.kpi_states(rows).persist()
    assert states.count() > rows.select(*kpis.SLICERS).distinct().count()

    def table(df):
        return {r[:4]: r[4:] for r in (tuple(x[c] for c in df.columns) for x in df.collect())}

    direct, got = kpis.kpi_cube(rows), cubes.cube_from_states(states)
    direct, got = table(direct), table(got.select(*direct.columns))
    assert got.keys() == direct.keys()
    assert all(got[k] == pytest.approx(direct[k]) for k in direct)
    chosen = {"Partner": ["Yes"], "gender": ["Male"]}
    assert cubes.cards_from_states(states, chosen).first() == pytest.approx(kpis.kpi_cards(rows, chosen).first())


def test_keys_that_are_no_numbers_are_no_customers(spark):
    df = spark.createDataFrame([("x", "a", 1, 5.0), ("1", "a", 0, float("nan")), (None, "a", None, None)],
                               "customerID string, s string, Churn_Flag int, MonthlyCharges double")
    row = cubes.cards_from_states(cubes.kpi_states(df, ["s"])).first()
    assert (row.retention_rate, row.total_customers, row.retained_customers, row.monthly_revenue) == (50.0, 1, 1, 5.0)


# --- lines -----------------------------------------------------------------------------

def test_every_line_is_kept_or_quarantined(spark, tmp_path):
    header = ",".join(S.RAW_COLUMNS)
    n = len(S.RAW_COLUMNS)
    fields = [f"v{i}" for i in range(n)]

    def line(**changed):
        return ",".join(changed.get(f"f{i}", f) for i, f in enumerate(fields))

    good = [line(), line(f1='"a,b"'), line(f2='"say ""x"", now"'), line(f0="", f1=""), line(**{f"f{n - 1}": ""}), line(f3=" padded ")]
    bad = {line(f1='"a'): "broken quotes", ",".join(fields[:-1]): f"too few fields: {n - 1}", "x": "too few fields: 1",
           line() + ",more,": f"too many fields: {n + 2}", line(f1='"a,b') + '"': f"too few fields: {1 + 1}"}
    (tmp_path / "one.csv").write_text("\n".join([header, *good, "", *bad]) + "\n")
    (tmp_path / "two.csv").write_text(f"{header}\n{good[0]}\n")
    kept, quarantined = source.rescue_csv(spark, str(tmp_path))
    rows = kept.collect()
    assert len(rows) == len(good) + 1 and kept.columns == list(S.RAW_COLUMNS)
    values = {tuple(r) for r in rows}
    assert any(v[1] == "a,b" for v in values) and any(v[3] == " padded " for v in values)
    got = {r.line: (r.file, r.reason) for r in quarantined.collect()}
    assert got == {k: ("one.csv", v) for k, v in bad.items()}


def test_numbers_survive_until_they_are_cleaned(spark):
    text = [["1"] * len(S.RAW_COLUMNS) for _ in range(3)]
    at = S.RAW_COLUMNS.index("tenure")
    for row, value in zip(text, ("12.0", "12.5", "none")):
        row[at] = value
    df = spark.createDataFrame(text, ", ".join(f"`{c}` string" for c in S.RAW_COLUMNS))
    assert [r.tenure for r in source.as_declared(df).collect()] == [12, None, None]
    assert source.as_declared(df).dtypes == [(f.name, f.dataType.simpleString()) for f in S.RAW_SCHEMA]


# --- written reports -------------------------------------------------------------------

def test_a_killed_and_repeated_write_leaves_one_version(spark, tmp_path):
    path = str(tmp_path / "report")
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    versions.write_version(spark.range(3), path, version="a")
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="killed"):
        versions.write_version(broken, path, version="b")
    assert versions.read_version(spark, path).count() == 3
    for _ in range(2):
        versions.write_version(spark.range(5), path, version="b")
    assert sorted(r.id for r in versions.read_version(spark, path).collect()) == [0, 1, 2, 3, 4]
    assert versions.manifest(spark, path) == {"version": "b", "format": "parquet", "schema": "`id` bigint", "rows": 5}
    versions.write_version(spark.range(2), path, "csv")
    assert versions.read_version(spark, path).count() == 2
    versions.write_version(spark.range(0), path)
    assert versions.read_version(spark, path).collect() == []


def test_only_written_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "parts")
    df = spark.range(20).select("id", (F.col("id") % 3).cast("int").alias("p"))
    for part in (df, df.where("p = 1").limit(2), df.where("p = 1").limit(2)):
        versions.write_parts(part, path, ["p"])
    counts = {r.p: r["count"] for r in spark.read.parquet(path).groupBy("p").count().collect()}
    assert counts == {0: 7, 1: 2, 2: 6}


# --- small samples ----------------------------------------------------------------------

@pytest.mark.parametrize("m, n", [(1, 1), (2, 5), (4, 4), (3, 8), (6, 6), (8, 8)])
def test_exact_p_equals_enumeration(m, n):
    counts = [0] * (m * n + 1)
    for chosen in combinations(range(m + n), m):
        counts[sum(chosen) - m * (m - 1) // 2] += 1
    assert rank_sum_counts(m, n) == counts
    for u in range(m * n + 1):
        above = sum(counts[max(u, m * n - u):])
        assert rank_sum_two_sided(u, m, n) == pytest.approx(min(1.0, 2 * above / math.comb(m + n, m)), abs=1e-15)


def test_exact_p_where_it_applies(spark):
    rng = random.Random(2)
    rows = [(int(i < 5), rng.gauss(i < 5, 1), float(i % 4), rng.random()) for i in range(12)]
    df = spark.createDataFrame(rows, "Churn_Flag int, a double, tied double, b double")
    got = {r.feature: r for r in hypothesis.mann_whitney(df, ["a", "tied", "b"]).collect()}
    for f, i in (("a", 1), ("b", 3)):
        one, zero = [r[i] for r in rows if r[0]], [r[i] for r in rows if not r[0]]
        u = sum(x > y for x in one for y in zero)
        assert got[f].U == u and got[f].p_value == pytest.approx(rank_sum_two_sided(u, 5, 7))
    assert got["tied"].p_value == pytest.approx(math.erfc(got["tied"].z / math.sqrt(2)))
    assert hypothesis.mann_whitney(df, ["a"]).columns == ["feature", "n1", "n0", "U", "z", "p_value"]


# --- missing values ---------------------------------------------------------------------

def test_nan_is_missing_everywhere(spark):
    whole = [(i % 2, float(x)) for i, x in enumerate([5, 6, 7, 9, 4, 8])]
    schema = "Churn_Flag int, v double"
    plain = spark.createDataFrame(whole, schema)
    holed = spark.createDataFrame(whole + [(1, float("nan")), (0, float("nan")), (0, None)], schema)
    for figures in (
        lambda df: distribution.distribution_stats(df, ["v"]), lambda df: hypothesis.welch_t(df, ["v"]),
        lambda df: hypothesis.mann_whitney(df, ["v"]), lambda df: distribution.iqr_outliers(df, ["v"]),
        lambda df: profile.profile_describe(df.select("v")),
    ):
        a, b = (tuple(figures(df).first()) for df in (plain, holed))
        assert len(a) == len(b) and all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(a, b))


def test_tables_of_one_kind_are_described(spark):
    numbers = profile.profile_describe(spark.createDataFrame([(1.0,), (3.0,)], "v double")).first()
    assert (numbers.p50, numbers.top, numbers.unique) == (2.0, None, None)
    text = profile.profile_describe(spark.createDataFrame([("a",), ("a",)], "t string")).first()
    assert (text.top, text.freq, text.p50) == ("a", 2, None)


# --- models and clusters ----------------------------------------------------------------

def test_stored_preprocessing_gives_equal_vectors(spark, features, tmp_path):
    frame = prep.ml_feature_frame(features)
    stages = [prep.Preprocessor(*prep.feature_types(frame)), LogisticRegression(labelCol="Churn_Flag", maxIter=5)]
    fitted = Pipeline(stages=stages).fit(frame)
    fitted.write().save(str(tmp_path / "fitted"))
    spark.newSession()
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    assert loaded.stages[0].uid == fitted.stages[0].uid and loaded.stages[0].scales.keys() == fitted.stages[0].scales.keys()

    def scored(model):
        rows = model.transform(frame).select("customerID", vector_to_array("features").alias("f"), vector_to_array("probability").alias("p"))
        return {r[0]: (r.f, r.p) for r in rows.collect()}

    assert scored(loaded) == scored(fitted)
    Pipeline(stages=stages).write().save(str(tmp_path / "plain"))
    again = Pipeline.load(str(tmp_path / "plain"))
    assert again.getStages()[0].numeric == stages[0].numeric and again.getStages()[0].categorical == stages[0].categorical


def brute_silhouette(x, labels):
    out = []
    for i in range(len(x)):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        means = {c: far[labels == c].sum() / max((labels == c).sum() - (c == labels[i]), 1) for c in set(labels.tolist())}
        a, b = means.pop(labels[i]), min(means.values())
        out.append(0.0 if (labels == labels[i]).sum() == 1 else (b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("block", [1024, 16])
def test_euclidean_silhouette_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "SILHOUETTE_BLOCK", block)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(90, 3)), 1)
    x[60:] = x[:30]
    labels = rng.integers(0, 3, 90)
    labels[0], labels[labels == 3] = 3, 0
    df = spark.createDataFrame([(int(c), a.tolist()) for c, a in zip(labels, x)], "cluster int, v array<double>")
    df = df.select("cluster", array_to_vector("v").alias("features"))
    assert cluster.euclidean_silhouette(df) == pytest.approx(brute_silhouette(x, labels), abs=1e-12)
    assert cluster.euclidean_silhouette(df.withColumn("cluster", F.lit(0))) is None
    with pytest.raises(ValueError):
        cluster.euclidean_silhouette(df, 10)


def test_a_workspace_follows_its_inputs(spark, tmp_path):
    from tests.conftest import DATA

    from tenura.plans.workspace import workspace

    for name in ("customer", "orders"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    first = workspace(spark, str(tmp_path))
    assert workspace(spark, f"{tmp_path}/") is first
    n = first.subscribers.count()
    some = spark.read.parquet(f"{DATA}/customer.parquet").limit(n // 2)
    some.write.mode("overwrite").parquet(str(tmp_path / "customer.parquet"))
    second = workspace(spark, str(tmp_path))
    assert second is not first and second.subscribers.count() == n // 2
