"""Distributed ranks and percentiles against pandas, on skewed small data."""

import random

import pytest
from pyspark.sql import functions as F

from tenura.operators import percentiles as P
from tenura.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, and a third of the values tied."""
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        group = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        value = 5.0 if rng.random() < 0.34 else round(rng.lognormvariate(3, 2), 2)
        rows.append((i, group, None if rng.random() < 0.02 else value, int(rng.random() < 0.3)))
    schema = "id int, g string, v double, flag int"
    return spark.createDataFrame(rows, schema).repartition(5).persist()


@pytest.fixture(scope="module")
def pdf(skewed):
    return skewed.toPandas()


@pytest.mark.parametrize("bracket", ["brackets", "blocks", "missed", "many_groups"])
def test_percentiles_equal_pandas(skewed, pdf, monkeypatch, bracket):
    if bracket == "blocks":
        monkeypatch.setattr(P, "WINDOW_VALUES", -1)
    if bracket == "missed":     # brackets that cannot hold the wanted values
        found = P._brackets
        far = F.array(*[F.lit(1e12)] * 10)
        monkeypatch.setattr(P, "_brackets", lambda *a: found(*a).withColumn("v", far))
    if bracket == "many_groups":     # more of them than Spark broadcasts
        monkeypatch.setattr(P, "_brackets", lambda *a, found=P._brackets: found(*a).hint("merge"))
    got = P.exact_percentiles(skewed, ["v"], [0, 0.25, 0.5, 0.9, 1], ["g"], list("abcde"))
    want = pdf.groupby("g", dropna=False)["v"].quantile([0, 0.25, 0.5, 0.9, 1]).unstack()
    rows = got.collect()
    assert len(rows) == 4
    for r in rows:
        expected = want[want.index.isna()].iloc[0] if r["g"] is None else want.loc[r["g"]]
        assert [r[c] for c in "abcde"] == pytest.approx(expected.tolist(), rel=1e-12)


def test_percentiles_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([(3.0, None)] * 5, "c double, n double")
    rows = P.exact_percentiles(df, ["c", "n"], [0.1, 0.5]).collect()
    assert [(r["metric"], r["p10"], r["p50"]) for r in rows] == [("c", 3.0, 3.0)]


def test_mode_is_the_smallest_of_ties(spark):
    df = spark.createDataFrame([(v,) for v in (3, 1, 3, 1, 2)], "x int")
    assert P.modes(df, ["x"]).first()["mode"] == 1.0


@pytest.mark.parametrize("partitions", [1, 2, 8])
def test_average_rank_equals_pandas(skewed, pdf, partitions):
    counts = R.running_counts(skewed.repartition(partitions), ["v"], ["g"])
    ranks = {(r["g"], r["v"]): r["avg_rank"] for r in R.average_rank(counts).collect()}
    known = pdf.dropna(subset="v").copy()
    known["g"] = known["g"].fillna("null")
    known["rank"] = known.groupby("g")["v"].rank(method="average")
    for r in known.itertuples():
        assert ranks[None if r.g == "null" else r.g, r.v] == r.rank


def test_lookup_by_value_small_and_split(skewed):
    counts = R.running_counts(skewed, ["v"])
    ranks = R.average_rank(counts).select("v", "n", F.col("avg_rank").alias("rank"))
    small = R.attach_by_value(skewed, ranks, "v", "rank", ["id"], ranks.count())
    split = R.attach_by_value(skewed, ranks, "v", "rank", ["id"], ranks.count(), broadcast_rows=0)
    assert small.columns == split.columns == [*skewed.columns, "rank"]
    assert small.exceptAll(split).isEmpty() and split.count() == skewed.count()
    assert split.where("v IS NOT NULL AND rank IS NULL").isEmpty()


def test_share_and_rank(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "k string, v double"
    ).withColumn("all", F.lit(1))
    rows = {r["k"]: r for r in df.select(
        "k", R.share_of_total("v", "all").alias("s"), R.metric_rank("v", "all").alias("r")
    ).collect()}
    assert [rows[k]["r"] for k in "abcd"] == [2, 1, 1, None]
    assert rows["b"]["s"] == pytest.approx(3 / 7)
    zeros = df.withColumn("v", F.lit(0.0))
    assert zeros.select(R.share_of_total("v", "all")).first()[0] is None
