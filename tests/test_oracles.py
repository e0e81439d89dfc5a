"""Every query with a SQL statement gives the rows of that statement."""

from collections import Counter

import pytest

from tenura.plans.catalog import build_queries
from tenura.plans.oracles import build_oracles

from .conftest import DATA

# One instance of each family; tools/check.py runs them all.
FAMILIES = {
    "segment_analysis": "tenure_group", "churn_rate_by": "paymentmethod",
    "segment_summary": "customer_value_band", "business_query": "risk_segment",
    "metric_summary": "contract_monthlycharges", "crosstab_pct": "tenure_group",
    "count_by_hue": "contract", "contingency_counts": "multiplelines",
    "distribution_stats": "tenure", "welch_t": "tenure", "mann_whitney": "monthlycharges",
    "chi_square": "partner",
}


def _chosen() -> list[str]:
    names = []
    for name in build_oracles():
        family = next((f for f in FAMILIES if name.startswith(f + "_")), None)
        if name == "metric_summary_all" or not family or name == f"{family}_{FAMILIES[family]}":
            names.append(name)
    return names


@pytest.mark.parametrize("name", _chosen())
def test_matches_sql(name, spark, duck):
    df = build_queries()[name](spark, DATA)
    cursor = duck.execute(build_oracles()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = Counter(cursor.fetchall())
    assert Counter(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()) == expected


def test_every_statement_belongs_to_a_query():
    assert set(build_oracles()) <= set(build_queries())


def test_rule_metrics_of_customers_without_orders_match_sql(spark, duck, tmp_path):
    """Customers without orders have no charges, so the rule gives them no score."""
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE customer AS SELECT i AS c_custkey, CAST(i * 7 % 25 AS INT) AS c_nationkey, "
                "CAST(i * 37 % 9000 AS DECIMAL(12,2)) AS c_acctbal, "
                "['BUILDING', 'MACHINERY', 'OTHER'][1 + i % 3] AS c_mktsegment FROM range(1, 301) t(i)")
    con.execute("CREATE TEMP TABLE orders AS SELECT i AS o_orderkey, 1 + i * 13 % 300 AS o_custkey, "
                "CAST('1995-01-01' AS DATE) + CAST(i * 31 % 1500 AS INT) AS o_orderdate, "
                "CAST(500 + i * 97 % 40000 AS DECIMAL(12,2)) AS o_totalprice, ['F', 'O', 'P'][1 + i % 3] AS o_orderstatus, "
                "['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'][1 + i % 4] AS o_orderpriority "
                "FROM range(1, 2001) t(i) WHERE (1 + i * 13 % 300) % 10 <> 0")
    for name in ("customer", "orders"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    for name in ("classification_metrics", "classification_report", "confusion_matrix"):
        df = build_queries()[name](spark, str(tmp_path))
        cursor = con.execute(build_oracles()[name])
        names = [d[0] for d in cursor.description]
        assert Counter(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()) == Counter(cursor.fetchall()), name
