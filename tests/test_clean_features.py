import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.functions.columns import churned, right_closed_bucket, significant, strip, to_number
from tenura.operators import clean, features
from tenura.plans.pipelines import clean_pipeline
from tenura.plans.sqlsuite import run
from tenura.sources import subscribers as source


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], ["  customer ID", "pay-method "])
    assert clean.clean_column_names(df).columns == ["customer_ID", "pay_method"]


def test_strip_removes_every_kind_of_whitespace(spark):
    df = spark.createDataFrame([("\t a b \n",), (None,)], "s string")
    assert [r[0] for r in df.select(strip("s")).collect()] == ["a b", None]


def test_tolerant_numbers(spark):
    df = spark.createDataFrame([(" ",), ("12.5",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(to_number("s")).collect()] == [None, 12.5, None, None]


def test_fill_total(spark):
    df = spark.createDataFrame(
        [(None, 10.0, 3), (None, None, 3), (7.0, 10.0, 3)],
        "TotalCharges double, MonthlyCharges double, tenure int",
    )
    assert [r[0] for r in clean.fill_total(df).collect()] == [30.0, 0.0, 7.0]


def test_pipeline_removes_padding_and_copies(spark, work):
    cleaned = clean_pipeline(work.raw)
    assert cleaned.count() == work.subscribers.count() < work.raw.count()
    assert cleaned.where("PaymentMethod LIKE ' %'").isEmpty()


def test_hot_copy_collapses(spark, work):
    one = work.subscribers.limit(1)
    many = one.crossJoin(spark.range(5000)).drop("id").unionByName(work.subscribers)
    assert clean.drop_duplicates(many).count() == work.subscribers.count()


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 12.0, 12.5, 72.0, 73.0, None)], "t double")
    _, edges, labels = S.BINS["Tenure_Group"]
    got = [r[0] for r in df.select(right_closed_bucket("t", edges, labels)).collect()]
    assert got == [None, "0-12", "0-12", "13-24", "61-72", None, None]


def test_bins_match_pandas(features):
    pdf = features.select("tenure", "MonthlyCharges", *S.BINS).toPandas()
    for name, (column, edges, labels) in S.BINS.items():
        want = pd.cut(pdf[column], edges, labels=labels).astype(object)
        assert want.where(want.notna(), None).tolist() == pdf[name].tolist()


def test_value_bands_match_pandas(features):
    pdf = features.select("Estimated_LTV", "Customer_Value_Band").toPandas()
    want = pd.qcut(pdf["Estimated_LTV"], 4, labels=S.VALUE_BANDS).astype(object)
    assert want.tolist() == pdf["Customer_Value_Band"].tolist()


def test_collapsed_bands_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "v double")
    with pytest.raises(ValueError, match="collapsed"):
        features_bands(df)


def features_bands(df):
    return features.bucket_quantile(df, "v", ["a", "b", "c", "d"], "band")


def test_null_rules(spark):
    df = spark.createDataFrame(
        [(None, 5.0, 1, None), (0, 5.0, 0, "Yes"), (3, None, 1, "No"), (3, None, 0, "No")],
        "tenure int, MonthlyCharges double, Churn_Flag int, PhoneService string",
    )
    ltv = [r.Estimated_LTV for r in features.derive_arithmetic(df).collect()]
    assert ltv == [None, 5.0, None, None]
    lost = [r.Revenue_Lost for r in features.derive_revenue_lost(df).collect()]
    assert lost == [5.0, 0.0, None, 0.0]
    risk = [r.Risk_Segment for r in features.risk_segment(df).collect()]
    assert risk == [S.RISK_DEFAULT, S.RISK_LABELS[1], S.RISK_DEFAULT, S.RISK_DEFAULT]


def test_churn_predicate(spark):
    df = spark.createDataFrame([("Yes",), ("1",), ("yes",), (None,)], "Churn string")
    assert [r[0] for r in df.select(churned()).collect()] == [1, 1, 0, 0]
    assert [r[0] for r in df.select(churned(collation="UTF8_LCASE")).collect()] == [1, 1, 1, 0]
    bits = spark.createDataFrame([(1,), (0,)], "Churn int")
    assert [r[0] for r in bits.select(churned()).collect()] == [1, 0]


def test_sql_reports_with_collation(spark, work):
    shouting = work.subscribers.withColumn("Churn", F.upper("Churn"))
    plain = run("sql_overall_churn", work.subscribers).first()
    assert run("sql_overall_churn", shouting, "UTF8_LCASE").first() == plain
    assert run("sql_overall_churn", shouting).first().churned_customers == 0


def test_significant_digits(spark):
    df = spark.createDataFrame([(1 / 3,), (None,), (0.0,)], "v double")
    assert [r[0] for r in df.select(significant("v", 3)).collect()] == [0.333, None, 0.0]


def test_csv_round_trip(spark, work, tmp_path):
    source.write_csv(work.subscribers, str(tmp_path / "csv"))
    back = source.read_csv(spark, str(tmp_path / "csv"))
    assert back.exceptAll(work.subscribers).isEmpty() and back.count() == work.subscribers.count()


def test_numbers_are_read_tolerantly(spark):
    df = spark.createDataFrame([("NaN", "12.0"), (" ", "12.5"), ("abc", "NaN"), ("7.5", "9999999999"), (None, "-3")], "d string, i string")
    got = clean.coerce_numbers(df, {"d": "double", "i": "int"}).collect()
    assert [r.d for r in got] == [None, None, None, 7.5, None] and [r.i for r in got] == [12, None, None, None, -3]
