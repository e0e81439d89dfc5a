"""Readers and writers for the one-row-per-customer table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.functions.columns import to_number
from tenura.schema import RAW_COLUMNS, RAW_SCHEMA


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV with the declared schema; nothing is inferred."""
    return spark.read.csv(
        path, schema=RAW_SCHEMA, header=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def rescue_csv(spark: SparkSession, path: str, columns: Sequence[str] = RAW_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) of a headed CSV whose records are single lines.

    Kept rows are all text, so that what a number column holds (``12.0`` in a whole
    number, say) survives until it is cleaned; see ``as_declared``. A line that has an odd
    number of quotes, or other than one field per column, is quarantined as (file,
    line, reason). Lines equal to the header are left out wherever they stand, and so
    are blank ones; every other line is in exactly one of the two."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    bare = F.regexp_replace("value", r'"(?:[^"]|"")*"', "q")
    n = F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1
    reason = F.when(quotes % 2 == 1, F.lit("broken quotes")).when(
        n < len(columns), F.concat(F.lit("too few fields: "), n.cast("string"))).when(
        n > len(columns), F.concat(F.lit("too many fields: "), n.cast("string")))
    header = ",".join(columns)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    lines = lines.where((F.trim("value") != "") & (F.replace("value", F.lit('"')) != header)).withColumn("reason", reason)
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    parsed = F.from_csv("value", schema, options)
    kept = lines.where("reason IS NULL").select(parsed.alias("r")).select("r.*")
    return kept, lines.where("reason IS NOT NULL").select("file", F.col("value").alias("line"), "reason")


def as_declared(text: DataFrame) -> DataFrame:
    """Text columns as the declared types; a whole number may be written with zeros
    after the point. What can't be read is null."""
    types = {f.name: f.dataType.simpleString() for f in RAW_SCHEMA}
    return text.select(*[
        F.col(c) if types[c] == "string" else to_number(F.col(c), types[c]).alias(c) for c in text.columns
    ])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA).parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def subscribers_sql(customer: str = "customer", orders: str = "orders") -> str:
    """The subscriber table expressed over customers and their orders.

    Churned means no order in the last nine months before the newest order.
    The text runs in Spark SQL and in DuckDB.
    """
    return f"""
WITH o AS (
  SELECT o_custkey,
         COUNT(*) AS n_orders,
         MIN(year(o_orderdate) * 12 + month(o_orderdate)) AS first_month,
         MAX(year(o_orderdate) * 12 + month(o_orderdate)) AS last_month,
         SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS spend,
         SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_f,
         SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS n_o,
         SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS n_p,
         SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n_urgent,
         SUM(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS n_high,
         SUM(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS n_medium,
         SUM(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS n_low
  FROM {orders} GROUP BY o_custkey
), b AS (
  SELECT c.*, o.*,
         (SELECT MAX(year(o_orderdate) * 12 + month(o_orderdate)) FROM {orders}) AS now_month,
         COALESCE(o.last_month - o.first_month, 0) AS t,
         CASE WHEN COALESCE(o.last_month - o.first_month, 0) > (c.c_custkey % 7) * 11
              THEN o.last_month - o.first_month - (c.c_custkey % 7) * 11 ELSE 0 END AS tenure_m
  FROM {customer} c LEFT JOIN o ON c.c_custkey = o.o_custkey
)
SELECT CAST(c_custkey AS VARCHAR(20)) AS customerID,
       CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
       CASE WHEN c_nationkey % 6 = 0 THEN 1 ELSE 0 END AS SeniorCitizen,
       CASE WHEN c_acctbal >= 4500 THEN 'Yes' ELSE 'No' END AS Partner,
       CASE WHEN c_nationkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS Dependents,
       CAST(tenure_m AS INT) AS tenure,
       CASE WHEN COALESCE(n_medium, 0) >= 1 THEN 'Yes' ELSE 'No' END AS PhoneService,
       CASE WHEN COALESCE(n_medium, 0) = 0 THEN 'No phone service'
            WHEN n_medium >= 3 THEN 'Yes' ELSE 'No' END AS MultipleLines,
       CASE c_nationkey % 5 WHEN 0 THEN 'No' WHEN 1 THEN 'DSL' WHEN 2 THEN 'DSL' ELSE 'Fiber optic' END AS InternetService,
       CASE WHEN c_nationkey % 5 = 0 THEN 'No internet service' WHEN n_p >= 4 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
       CASE WHEN c_nationkey % 5 = 0 THEN 'No internet service' WHEN n_urgent >= 2 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
       CASE WHEN c_nationkey % 5 = 0 THEN 'No internet service' WHEN n_high >= 3 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
       CASE WHEN c_nationkey % 5 = 0 THEN 'No internet service' WHEN n_low >= 2 THEN 'Yes' ELSE 'No' END AS TechSupport,
       CASE WHEN c_nationkey % 5 = 0 THEN 'No internet service' WHEN n_f >= 4 THEN 'Yes' ELSE 'No' END AS StreamingTV,
       CASE WHEN c_nationkey % 5 = 0 THEN 'No internet service' WHEN n_o >= 4 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Two year' WHEN 'MACHINERY' THEN 'One year' ELSE 'Month-to-month' END AS Contract,
       CASE WHEN c_custkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS PaperlessBilling,
       CASE c_custkey % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
            WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
       ROUND(CAST(spend AS DOUBLE) / (CASE WHEN t < 1 THEN 1 ELSE t END) / 500.0E0, 2) AS MonthlyCharges,
       CASE WHEN tenure_m = 0 THEN ' ' ELSE CAST(CAST(spend AS DECIMAL(18,2)) AS VARCHAR(30)) END AS TotalCharges,
       CASE WHEN last_month >= now_month - 9 THEN 'No' ELSE 'Yes' END AS Churn
FROM b
"""


def subscribers(customer: DataFrame, orders: DataFrame) -> DataFrame:
    spark = customer.sparkSession
    text = subscribers_sql("{customer}", "{orders}")
    return spark.sql(text, customer=customer, orders=orders).select(*RAW_COLUMNS)


def with_dirt(df: DataFrame) -> DataFrame:
    """The same subscribers as a raw delivery: padded text and repeated rows."""
    number = F.col("customerID").cast("int")
    padded = F.when(
        number % 10 == 0, F.concat(F.lit("  "), F.col("PaymentMethod"), F.lit(" "))
    ).otherwise(F.col("PaymentMethod"))
    return df.withColumn("PaymentMethod", padded).unionByName(df.where(number % 25 == 1))


def write_report(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write an aggregate, such as the table behind a chart."""
    df.write.mode("errorifexists").option("header", True).format(file_format).save(path)
