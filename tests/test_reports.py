import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.functions.columns import mean, total
from tenura.operators import kpis, profile, quality, segments


@pytest.mark.parametrize("dim", ["Contract", "Tenure_Group", "Service_Count"])
def test_segment_analysis_equals_pandas(features, dim):
    pdf = features.toPandas()
    rows = {r[dim]: r for r in segments.segment_analysis(features, dim).collect()}
    grouped = pdf.groupby(dim, dropna=False)
    for key, part in grouped:
        row = rows[None if pd.isna(key) else key]
        assert row.Customers == part.customerID.nunique()
        assert row.Churned_Customers == part.Churn_Flag.sum()
        assert row.Churn_Rate == pytest.approx(part.Churn_Flag.mean() * 100)
        assert row.Avg_Total_Charges == pytest.approx(part.TotalCharges.mean())
        assert row.Annual_Revenue == pytest.approx(part.Annual_Revenue.sum())
        assert row.Churn_Rate + row.Retention_Rate == pytest.approx(100)
    assert sum(r.Customers for r in rows.values()) == len(pdf)


def test_checked_unique_ids_give_the_same_report(features, work):
    assert work.unique_ids
    a = segments.business_query(features, "Contract", unique_ids=False).collect()
    assert a == segments.business_query(features, "Contract", unique_ids=True).collect()
    assert not quality.has_unique_ids(features.unionByName(features.limit(1)))


def test_empty_categories_are_reported(features):
    cheap = features.where("MonthlyCharges <= 60")
    rows = {r[0]: r for r in segments.segment_analysis(cheap, "MonthlyCharge_Group").collect()}
    assert set(rows) == set(S.BINS["MonthlyCharge_Group"][2])
    assert rows[">120"].Customers == 0 and rows[">120"].Annual_Revenue == 0.0
    assert rows[">120"].Avg_Tenure is None
    summary = segments.segment_summary(cheap, "Charge_Segment").collect()
    assert [r[0] for r in summary] == S.BINS["Charge_Segment"][2]
    assert summary[2].Customers == 0
    without = segments.segment_summary(cheap, "Charge_Segment", include_empty=False)
    assert without.count() == 2
    metric = segments.metric_summary(cheap, "MonthlyCharge_Group", "tenure").collect()
    empty = next(r for r in metric if r[0] == ">120")
    assert empty["count"] == 0 and empty["mean"] is None and empty["metric_rank"] is None


def test_all_summaries_equal_the_single_ones(features):
    dims, metrics = ["Contract", "Tenure_Group"], ["MonthlyCharges", "tenure", "Revenue_Lost"]
    together = segments.metric_summary_all(features, dims, metrics)
    for d in dims:
        for m in metrics:
            one = segments.metric_summary(features, d, m)
            part = together.where((F.col("dim") == d) & (F.col("metric") == m))
            a = {r[d]: r for r in one.collect()}
            b = {r["dim_value"]: r for r in part.collect()}
            assert set(a) == set(b)
            for k in a:
                for c in ("count", "sum", "mean", "median", "min", "max", "std",
                          "share_of_total", "metric_rank"):
                    assert a[k][c] == pytest.approx(b[k][c])
    shares = together.groupBy("dim", "metric").agg(F.sum("share_of_total").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in shares)


def test_all_summaries_have_the_empty_labels_of_the_single_ones(features):
    cheap = features.where("tenure <= 12 AND MonthlyCharges <= 60")
    together = segments.metric_summary_all(cheap)
    singles = None
    for d in S.METRIC_DIMS:
        rows = cheap.where(F.lit(True))
        one = segments.metric_summary(rows, d, "tenure").withColumnRenamed(d, "dim_value")
        one = one.select(F.lit(d).alias("dim"), F.col("dim_value").cast("string"), "count", "sum", "metric_rank")
        singles = one if singles is None else singles.unionByName(one)
    part = together.where("metric = 'tenure'").select(*singles.columns)
    assert sorted(map(str, part.collect())) == sorted(map(str, singles.collect()))
    rates = {r[0]: r[1] for r in segments.churn_rate_by(cheap, "Tenure_Group").collect()}
    assert set(rates) == set(S.BINS["Tenure_Group"][2]) and rates["61-72"] is None
    assert len(segments.churn_rate_by(cheap, "Tenure_Group", include_empty=False).collect()) == 1


def test_sums_and_means_are_exact(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("few", 0.004), ("few", 0.004), ("few", 10.125), ("nan", nan), ("nan", 5.0), ("nan", None),
            ("large", 1e300), ("large", 1e25), ("tiny", 1e-15), ("tiny", 2e-15), ("inf", inf), ("inf", 1.0), ("none", nan)]
    got = {r.k: (r.total, r.mean) for r in spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(
        total("v").alias("total"), mean("v").alias("mean")).collect()}
    assert got["few"] == (10.133, pytest.approx(10.133 / 3)) and got["nan"] == (5.0, 5.0)
    assert got["large"] == (1e300, 5e299) and got["tiny"] == (pytest.approx(3e-15), pytest.approx(1.5e-15))
    assert got["inf"] == (inf, inf) and got["none"] == (0.0, None)
    summary = segments.metric_summary(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()
    assert {r.k: r["count"] for r in summary}["nan"] == 1


def test_single_row_and_all_null_groups(spark):
    df = spark.createDataFrame(
        [("one", 4.0), ("none", None), ("none", None)], "k string, v double"
    )
    rows = {r["k"]: r for r in segments.metric_summary(df, "k", "v").collect()}
    assert rows["one"]["std"] is None and rows["one"]["median"] == 4.0
    assert rows["none"]["sum"] == 0.0 and rows["none"]["mean"] is None
    assert rows["none"]["metric_rank"] is None and rows["none"]["median"] is None


def test_crosstab_rows_sum_to_hundred(features):
    pdf = features.toPandas()
    want = pd.crosstab(pdf.Tenure_Group, pdf.Churn, normalize="index").mul(100)
    rows = segments.crosstab_pct(features, "Tenure_Group").collect()
    assert [r[0] for r in rows] == list(want.index)
    for r in rows:
        assert r["No"] + r["Yes"] == pytest.approx(100)
        assert r["Yes"] == pytest.approx(want.loc[r[0], "Yes"])


def test_reports_do_not_depend_on_partitions(features):
    reports = [
        segments.business_query(features.repartition(n), "PaymentMethod").collect()
        for n in (1, 2, 8)
    ]
    assert reports[0] == reports[1] == reports[2]


def test_cube_grand_total_is_the_kpis(features):
    total = kpis.kpi_cube(features).where("level = 7").first()
    values = {r.kpi: r.value for r in kpis.core_kpis(features).collect()}
    assert total.total_customers == values["Total Customers"]
    assert total.monthly_revenue == values["Monthly Revenue"]
    assert total.retention_rate == values["Retention Rate (%)"]


def test_bayes_identity(features):
    p = {r.probability: r.value for r in kpis.probabilities(features).collect()}
    assert p["p_joint_reconstructed"] == pytest.approx(p["p_month_to_month_and_churn"])
    assert p["p_churn"] + p["p_no_churn"] == pytest.approx(1)


def test_json_report(features):
    text = kpis.report_json(kpis.business_report(features)).first().report
    report = json.loads(text)
    assert report["customers"] == features.count() and len(report) == 10


def test_quality_checks(spark):
    df = spark.createDataFrame(
        [("1", "Yes", -1.0, "5"), ("1", "Yes", -1.0, "5"), ("2", "maybe", 2.0, " "),
         ("3", None, None, "-4"), ("3", None, None, "-4"), ("3", None, None, "-4")],
        "customerID string, Churn string, MonthlyCharges double, TotalCharges string",
    )
    assert quality.duplicate_rows(df).first()[0] == 3
    assert [r[0] for r in quality.check_invalid_values(df).collect()] == ["maybe"]
    assert {r.column_name: r.negative for r in quality.check_negative(df).collect()} == {
        "MonthlyCharges": 2, "TotalCharges": 3,
    }
    report = {r.check_name: r.value for r in quality.quality_report(df).collect()}
    assert report == {
        "rows": 6, "missing_values": 6, "negative_charges": 2, "negative_total_charges": 3,
        "duplicates": 3, "unique_customers": 3, "invalid_target_values": 1,
    }


def test_sample_is_the_same_under_any_partitioning(work):
    a = profile.profile_sample(work.subscribers.repartition(1)).collect()
    assert a == profile.profile_sample(work.subscribers.repartition(7)).collect()


def test_report_reads_only_its_columns_and_pushes_the_filter(features):
    df = kpis.kpi_cards(features, {"Partner": ["Yes"]}, unique_ids=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TechSupport" not in plan.split("ReadSchema")[1]
    assert "In(Partner" in plan or "EqualTo(Partner,Yes)" in plan
