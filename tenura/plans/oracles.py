"""An independent SQL statement (DuckDB dialect) for each query that SQL can express.

The statements derive cleaned rows and features on their own, from the customer
and order tables, and share nothing with the DataFrame operators but names.
"""

from __future__ import annotations

from tenura import schema as S
from tenura.sources.subscribers import subscribers_sql

RAW = ", ".join(S.RAW_COLUMNS)

_RAW_CTE = f"""subscribers AS ({subscribers_sql()}),
subscribers_raw AS (
  SELECT * REPLACE (CASE WHEN CAST(customerID AS INT) % 10 = 0
                         THEN CONCAT('  ', PaymentMethod, ' ') ELSE PaymentMethod END
                    AS PaymentMethod)
  FROM subscribers
  UNION ALL
  SELECT * FROM subscribers WHERE CAST(customerID AS INT) % 25 = 1
)"""

_FEATURE_CTE = _RAW_CTE + """,
clean AS (
  SELECT DISTINCT * REPLACE (
           TRIM(PaymentMethod) AS PaymentMethod,
           COALESCE(TRY_CAST(TRIM(TotalCharges) AS DOUBLE), MonthlyCharges * tenure, 0.0E0)
             AS TotalCharges),
         CAST(CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS TINYINT) AS Churn_Flag,
         CASE SeniorCitizen WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS SeniorCitizen_Label
  FROM subscribers_raw
), f1 AS (
  SELECT *,
         CASE WHEN tenure <= -1 THEN NULL WHEN tenure <= 12 THEN '0-12' WHEN tenure <= 24 THEN '13-24'
              WHEN tenure <= 36 THEN '25-36' WHEN tenure <= 48 THEN '37-48' WHEN tenure <= 60 THEN '49-60'
              WHEN tenure <= 72 THEN '61-72' END AS Tenure_Group,
         tenure / 12.0E0 AS Tenure_Year,
         CASE WHEN MonthlyCharges <= 35 THEN '<=35' WHEN MonthlyCharges <= 60 THEN '36-60'
              WHEN MonthlyCharges <= 90 THEN '61-90' WHEN MonthlyCharges <= 120 THEN '91-120'
              WHEN MonthlyCharges > 120 THEN '>120' END AS MonthlyCharge_Group,
         MonthlyCharges * 12 AS Annual_Revenue,
         CASE WHEN Churn_Flag = 1 THEN MonthlyCharges ELSE 0.0E0 END AS Revenue_Lost,
         MonthlyCharges * CASE WHEN tenure < 1 THEN 1 ELSE tenure END AS Estimated_LTV,
         CASE WHEN PhoneService = 'Yes' THEN 1 ELSE 0 END + CASE WHEN OnlineSecurity = 'Yes' THEN 1 ELSE 0 END
           + CASE WHEN OnlineBackup = 'Yes' THEN 1 ELSE 0 END + CASE WHEN DeviceProtection = 'Yes' THEN 1 ELSE 0 END
           + CASE WHEN TechSupport = 'Yes' THEN 1 ELSE 0 END + CASE WHEN StreamingTV = 'Yes' THEN 1 ELSE 0 END
           + CASE WHEN StreamingMovies = 'Yes' THEN 1 ELSE 0 END AS Service_Count,
         CASE WHEN OnlineSecurity = 'Yes' THEN 1 ELSE 0 END + CASE WHEN TechSupport = 'Yes' THEN 1 ELSE 0 END AS Support_Count,
         CASE WHEN StreamingTV = 'Yes' THEN 1 ELSE 0 END + CASE WHEN StreamingMovies = 'Yes' THEN 1 ELSE 0 END AS Streaming_Count,
         CASE WHEN Contract = 'Month-to-month' THEN 1 ELSE 0 END AS Is_Month_To_Month,
         CASE WHEN Partner = 'Yes' THEN 1 ELSE 0 END AS Has_Partner,
         CASE WHEN Dependents = 'Yes' THEN 1 ELSE 0 END AS Has_Dependents,
         CASE WHEN PaperlessBilling = 'Yes' THEN 1 ELSE 0 END AS Paperless_Flag,
         CASE WHEN PaymentMethod = 'Electronic check' THEN 1 ELSE 0 END AS Electronic_Check_Flag,
         CASE WHEN tenure <= -1 THEN NULL WHEN tenure <= 12 THEN 'New' WHEN tenure <= 36 THEN 'Mid-Tenure'
              WHEN tenure <= 72 THEN 'Long-Term' END AS Tenure_Segment,
         CASE WHEN MonthlyCharges <= 50 THEN 'Low Charge' WHEN MonthlyCharges <= 90 THEN 'Medium Charge'
              WHEN MonthlyCharges > 90 THEN 'High Charge' END AS Charge_Segment,
         CASE WHEN tenure <= 12 AND MonthlyCharges >= 70 THEN 'High Risk: New + High Charge'
              WHEN tenure <= 12 AND MonthlyCharges < 70 THEN 'Medium Risk: New + Lower Charge'
              WHEN tenure > 12 AND MonthlyCharges >= 90 THEN 'Potential Risk: Existing + High Charge'
              ELSE 'Lower Observed Risk' END AS Risk_Segment
  FROM clean
), qs AS (
  SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY Estimated_LTV) AS q1,
         percentile_cont(0.50) WITHIN GROUP (ORDER BY Estimated_LTV) AS q2,
         percentile_cont(0.75) WITHIN GROUP (ORDER BY Estimated_LTV) AS q3 FROM f1
), feat AS (
  SELECT f1.*, CASE WHEN Estimated_LTV <= q1 THEN 'Low' WHEN Estimated_LTV <= q2 THEN 'Medium'
                    WHEN Estimated_LTV <= q3 THEN 'High' WHEN Estimated_LTV > q3 THEN 'Very High' END AS Customer_Value_Band
  FROM f1, qs
)"""


def on_raw(select: str, more: str = "") -> str:
    return f"WITH {_RAW_CTE}{more}\n{select}"


def on_features(select: str, more: str = "") -> str:
    return f"WITH {_FEATURE_CTE}{more}\n{select}"


def sig(expression: str) -> str:
    """Ten significant digits, with halfway cases nudged up."""
    return f"(CAST(printf('%.9e', CAST({expression} AS DOUBLE) * 1.000000000001E0) AS DOUBLE) + 0.0E0)"


def six_places(expression: str) -> str:
    """For quantiles of amounts, which are multiples of a fraction of a cent."""
    return f"ROUND(CAST({expression} AS DOUBLE), 6)"


def eight_places(expression: str) -> str:
    """For figures between -1 and 1, where the noise is absolute."""
    return f"(ROUND(CAST({expression} AS DOUBLE), 8) + 0.0E0)"


def total(c: str) -> str:
    return sig(f"COALESCE(SUM(CAST({c} AS DOUBLE)), 0)")


def mean(c: str) -> str:
    return sig(f"AVG(CAST({c} AS DOUBLE))")


_SCATTERED = "CASE WHEN tenure <= 24 THEN '0-12' ELSE '61-72' END"
_RATE = "AVG(Churn_Flag) * 100"
_CHURNED = "CASE WHEN CAST(Churn AS VARCHAR(3)) IN ('Yes', '1') THEN 1 ELSE 0 END"
_SQL_RATE = f"ROUND(100.0E0 * SUM({_CHURNED}) / COUNT(*), 2)"


def _segment_analysis(d: str) -> str:
    return on_features(f"""
SELECT {d}, COUNT(DISTINCT customerID) AS Customers,
       CAST(SUM(Churn_Flag) AS BIGINT) AS Churned_Customers, {_RATE} AS Churn_Rate,
       {mean('MonthlyCharges')} AS Avg_Monthly_Charges, {mean('TotalCharges')} AS Avg_Total_Charges,
       {mean('tenure')} AS Avg_Tenure, {total('Revenue_Lost')} AS Revenue_Lost,
       {total('Annual_Revenue')} AS Annual_Revenue, 100 - {_RATE} AS Retention_Rate
FROM feat GROUP BY {d} ORDER BY Churn_Rate DESC NULLS LAST, {d}""")


def _segment_summary(d: str) -> str:
    return on_features(f"""
SELECT {d}, COUNT(DISTINCT customerID) AS Customers, CAST(SUM(Churn_Flag) AS BIGINT) AS Churned,
       {_RATE} AS Churn_Rate, {mean('MonthlyCharges')} AS Avg_Monthly_Charge,
       {mean('Estimated_LTV')} AS Avg_LTV, {total('Revenue_Lost')} AS Revenue_Lost,
       100 - {_RATE} AS Retention_Rate
FROM feat WHERE {d} IS NOT NULL GROUP BY {d}""")


def _business_query(d: str) -> str:
    return on_features(f"""
SELECT {d}, COUNT(DISTINCT customerID) AS customer_count,
       CAST(SUM(Churn_Flag) AS BIGINT) AS churned_count,
       COUNT(*) FILTER (WHERE Churn_Flag = 0) AS retained_count,
       {_RATE} AS churn_rate, (1 - AVG(Churn_Flag)) * 100 AS retention_rate,
       {total('MonthlyCharges')} AS monthly_revenue, {total('Annual_Revenue')} AS annual_revenue,
       {total('Revenue_Lost')} AS revenue_lost, {mean('tenure')} AS average_tenure,
       {mean('MonthlyCharges')} AS average_monthly_charge, {mean('Estimated_LTV')} AS average_ltv
FROM feat GROUP BY {d} ORDER BY churn_rate DESC NULLS LAST, {d}""")


def _metric_summary(d: str, m: str) -> str:
    return on_features(f"""
SELECT {d}, "count", {sig('"sum"')} AS "sum", {sig('"mean"')} AS "mean", median, "min", "max", std,
       {sig('"sum" / SUM("sum") OVER ()')} AS share_of_total,
       CASE WHEN "mean" IS NOT NULL
            THEN DENSE_RANK() OVER (ORDER BY "mean" DESC NULLS LAST)::INT END AS metric_rank
FROM g""", f""", g AS (
  SELECT {d}, COUNT({m}) AS "count", COALESCE(SUM(CAST({m} AS DOUBLE)), 0) AS "sum", AVG(CAST({m} AS DOUBLE)) AS "mean",
         {six_places(f'quantile_cont(CAST({m} AS DOUBLE), 0.5)')} AS median,
         CAST(MIN({m}) AS DOUBLE) AS "min", CAST(MAX({m}) AS DOUBLE) AS "max",
         {sig(f'stddev_samp({m})')} AS std
  FROM feat GROUP BY {d}
)""")


def _metric_summaries(dims: list[str], metrics: list[str], columns: str) -> str:
    """All pairs as one statement: rows per dimension and metric, then groups."""
    parts = "\n  UNION ALL ".join(
        f"SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS dim_value, '{m}' AS metric, "
        f"CAST({m} AS DOUBLE) AS v FROM feat" for d in dims for m in metrics
    )
    return on_features(f"""
SELECT {columns} FROM (
  SELECT * REPLACE ({sig('"sum"')} AS "sum", {sig('"mean"')} AS "mean"),
         {sig('"sum" / SUM("sum") OVER (PARTITION BY dim, metric)')} AS share_of_total,
         CASE WHEN "mean" IS NOT NULL THEN DENSE_RANK() OVER (
           PARTITION BY dim, metric ORDER BY "mean" DESC NULLS LAST)::INT END AS metric_rank
  FROM g)""", f""", pairs AS (
  {parts}
), g AS (
  SELECT dim, dim_value, metric, COUNT(v) AS "count", COALESCE(SUM(v), 0) AS "sum", AVG(v) AS "mean",
         {six_places('quantile_cont(v, 0.5)')} AS median, MIN(v) AS "min", MAX(v) AS "max",
         {sig('stddev_samp(v)')} AS std
  FROM pairs GROUP BY dim, dim_value, metric
)""")


def _churn_rate_by(d: str) -> str:
    return on_features(
        f"SELECT {d}, {_RATE} AS churn_rate FROM feat GROUP BY {d} "
        f"ORDER BY churn_rate DESC NULLS LAST, {d}"
    )


def _crosstab(d: str, scale: str, names: tuple[str, str], test: str) -> str:
    no, yes = names
    n = "COUNT(*) FILTER (WHERE {})"
    return on_features(f"""
SELECT {d}, CAST({n.format(f'NOT ({test})')} AS DOUBLE) / COUNT(*) * {scale} AS "{no}",
       CAST({n.format(test)} AS DOUBLE) / COUNT(*) * {scale} AS "{yes}"
FROM feat WHERE {d} IS NOT NULL AND Churn IS NOT NULL GROUP BY {d}""")


def _count_by_hue(d: str) -> str:
    return on_features(
        f"SELECT {d}, Churn, COUNT(*) AS n FROM feat "
        f"WHERE {d} IS NOT NULL AND Churn IS NOT NULL GROUP BY {d}, Churn"
    )


def _contingency(d: str) -> str:
    return on_features(
        f"SELECT {d}, COUNT(*) FILTER (WHERE Churn_Flag = 0) AS retained, "
        f"COUNT(*) FILTER (WHERE Churn_Flag = 1) AS churned "
        f"FROM feat WHERE {d} IS NOT NULL AND Churn_Flag IS NOT NULL GROUP BY {d}"
    )


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _distribution(metrics: list[str]) -> str:
    def one(m: str) -> str:
        v = f"CAST({m} AS DOUBLE)"

        def q(p: float) -> str:
            return f"quantile_cont({v}, {p})"
        return f"""SELECT '{m}' AS metric, COUNT({m}) AS "count", {mean(m)} AS "mean",
       {six_places(q(0.5))} AS median,
       (SELECT v FROM (SELECT {v} AS v, COUNT(*) AS n FROM feat WHERE {m} IS NOT NULL GROUP BY 1)
        ORDER BY n DESC, v LIMIT 1) AS "mode",
       {sig(f'stddev_samp({m})')} AS std, {sig(f'var_samp({m})')} AS variance,
       MIN({v}) AS "min", {six_places(q(0.25))} AS q1, {six_places(q(0.5))} AS q2, {six_places(q(0.75))} AS q3,
       MAX({v}) AS "max", {six_places(f'MAX({v}) - MIN({v})')} AS "range",
       {six_places(f'{q(0.75)} - {q(0.25)}')} AS iqr,
       {sig(f'skewness({v})')} AS skew, {sig(f'kurtosis({v})')} AS kurtosis
FROM feat"""
    return on_features(_union([one(m) for m in metrics]))


def _kpis() -> str:
    figures = {
        "Total Customers": "COUNT(DISTINCT customerID)",
        "Churned Customers": "SUM(Churn_Flag)",
        "Retained Customers": "COUNT(*) FILTER (WHERE Churn_Flag = 0)",
        "Churn Rate (%)": _RATE,
        "Retention Rate (%)": f"100 - {_RATE}",
        "Monthly Revenue": total("MonthlyCharges"),
        "Annual Revenue": total("Annual_Revenue"),
        "Revenue Lost from Churn": total("Revenue_Lost"),
        "Average Monthly Charge": mean("MonthlyCharges"),
        "Average Tenure": mean("tenure"),
        "Average Estimated LTV": mean("Estimated_LTV"),
        "ARPU": "SUM(MonthlyCharges) / COUNT(DISTINCT customerID)",
    }
    return on_features(_union([
        f"SELECT '{name}' AS kpi, {sig(f)} AS value FROM feat"
        for name, f in figures.items()
    ]))


_REPORT = f"""SELECT COUNT(DISTINCT customerID) AS customers,
       CAST(SUM(Churn_Flag) AS BIGINT) AS churned,
       COUNT(*) FILTER (WHERE Churn_Flag = 0) AS retained, {_RATE} AS churn_rate_pct,
       (1 - AVG(Churn_Flag)) * 100 AS retention_rate_pct,
       {total('MonthlyCharges')} AS monthly_revenue, {total('Annual_Revenue')} AS annual_revenue,
       {total('Revenue_Lost')} AS revenue_lost, {mean('tenure')} AS average_tenure,
       {mean('MonthlyCharges')} AS average_monthly_charge
FROM feat"""


def _probabilities() -> str:
    m2m = "AVG(Churn_Flag) FILTER (WHERE Contract = 'Month-to-month')"
    share = "AVG(CASE WHEN Contract = 'Month-to-month' THEN 1.0E0 ELSE 0.0E0 END)"
    figures = {
        "p_churn": "AVG(Churn_Flag)",
        "p_no_churn": "1 - AVG(Churn_Flag)",
        "p_churn_given_month_to_month": m2m,
        "p_churn_given_electronic_check":
            "AVG(Churn_Flag) FILTER (WHERE PaymentMethod = 'Electronic check')",
        "p_month_to_month_and_churn":
            "AVG(CASE WHEN Contract = 'Month-to-month' AND Churn_Flag = 1 THEN 1.0E0 ELSE 0.0E0 END)",
        "p_month_to_month": share,
        "p_joint_reconstructed": f"{m2m} * {share}",
    }
    return on_features(_union([
        f"SELECT '{name}' AS probability, {sig(f)} AS value FROM feat"
        for name, f in figures.items()
    ]))


def _cards(distinct: str = "COUNT(DISTINCT customerID)") -> str:
    return f"""100 - {_RATE} AS retention_rate, {distinct} AS total_customers,
       COUNT(*) FILTER (WHERE Churn_Flag = 0) AS retained_customers,
       {mean('MonthlyCharges')} AS avg_monthly_charges,
       {total('MonthlyCharges')} AS monthly_revenue"""


def _welch(features: list[str]) -> str:
    def one(f: str) -> str:
        return f"""SELECT '{f}' AS feature,
  COUNT({f}) FILTER (WHERE Churn_Flag = 1) AS n1, COUNT({f}) FILTER (WHERE Churn_Flag = 0) AS n0,
  AVG({f}) FILTER (WHERE Churn_Flag = 1) AS m1, AVG({f}) FILTER (WHERE Churn_Flag = 0) AS m0,
  var_samp({f}) FILTER (WHERE Churn_Flag = 1) AS v1,
  var_samp({f}) FILTER (WHERE Churn_Flag = 0) AS v0 FROM feat"""
    return on_features(f"""
SELECT feature, n1, n0, {sig('m1')} AS mean1, {sig('m0')} AS mean0,
       {sig('(m1 - m0) / sqrt(v1 / n1 + v0 / n0)')} AS t_statistic,
       {sig('pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1))')} AS df
FROM s""", f""", s AS (
{_union([one(f) for f in features])}
)""")


def _mann_whitney(features: list[str]) -> str:
    values = _union([
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, Churn_Flag FROM feat "
        f"WHERE {f} IS NOT NULL AND Churn_Flag IS NOT NULL" for f in features
    ])
    return on_features(f"""
SELECT feature, n1, n0, U,
       {sig('(GREATEST(U, n1 * n0 - U) - n1 * n0 / 2.0E0 - 0.5E0) / sqrt(n1 * n0 / 12.0E0 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1.0E0))))')} AS z
FROM (SELECT *, r1 - n1 * (n1 + 1) / 2.0E0 AS U FROM u)""", f""", vals AS (
{values}
), ranked AS (
  SELECT feature, Churn_Flag, v,
         RANK() OVER (PARTITION BY feature ORDER BY v)
           + (COUNT(*) OVER (PARTITION BY feature, v) - 1) / 2.0E0 AS r
  FROM vals
), tie AS (
  SELECT feature, CAST(SUM(n * n * n - n) AS DOUBLE) AS ties
  FROM (SELECT feature, v, COUNT(*) AS n FROM vals GROUP BY feature, v) GROUP BY feature
), u AS (
  SELECT ranked.feature, COUNT(*) FILTER (WHERE Churn_Flag = 1) AS n1,
         COUNT(*) FILTER (WHERE Churn_Flag = 0) AS n0,
         SUM(r) FILTER (WHERE Churn_Flag = 1) AS r1, ANY_VALUE(ties) AS ties
  FROM ranked JOIN tie ON ranked.feature = tie.feature GROUP BY ranked.feature
)""")


def _cells(dims: list[str]) -> str:
    observed = _union([
        f"SELECT '{d}' AS dim, CAST({d} AS VARCHAR) AS value, CAST(Churn_Flag AS INT) AS flag "
        f"FROM feat WHERE {d} IS NOT NULL AND Churn_Flag IS NOT NULL" for d in dims
    ])
    return f""", keys AS (
{observed}
), seen AS (SELECT dim, value, flag, COUNT(*) AS n FROM keys GROUP BY dim, value, flag
), grid AS (
  SELECT v.dim, v.value, f.flag, COALESCE(n, 0) AS observed
  FROM (SELECT DISTINCT dim, value FROM keys) v
  JOIN (SELECT DISTINCT dim, flag FROM keys) f ON v.dim = f.dim
  LEFT JOIN seen ON seen.dim = v.dim AND seen.value = v.value AND seen.flag = f.flag
), cells AS (
  SELECT *, CAST(SUM(observed) OVER (PARTITION BY dim, value) AS DOUBLE)
            * SUM(observed) OVER (PARTITION BY dim, flag)
            / SUM(observed) OVER (PARTITION BY dim) AS expected
  FROM grid
), shape AS (
  SELECT dim, (COUNT(DISTINCT value) - 1) * (COUNT(DISTINCT flag) - 1) AS dof
  FROM grid GROUP BY dim
)"""


def _chi_square(dims: list[str]) -> str:
    return on_features(f"""
SELECT dim, {sig('SUM(pow(ABS(observed - expected) - CASE WHEN dof = 1 THEN LEAST(0.5E0, ABS(observed - expected)) ELSE 0 END, 2) / expected)')} AS chi2,
       MAX(dof) AS dof
FROM cells JOIN shape USING (dim) GROUP BY dim""", _cells(dims))


def _pairs(name: str, one) -> str:
    """A CTE (column_a, column_b, correlation); one(a, b) selects a pair's r."""
    names = S.CORRELATION_COLUMNS
    upper = _union([
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, ({one(a, b)}) AS r"
        for i, a in enumerate(names) for b in names[i + 1:]
    ])
    same = _union([f"SELECT '{c}', '{c}', 1.0E0" for c in names])
    return f""", {name}_upper AS MATERIALIZED (
{upper}
), {name} AS (
  SELECT column_a, column_b, {eight_places('r')} AS correlation
  FROM (SELECT * FROM {name}_upper UNION ALL SELECT column_b, column_a, r FROM {name}_upper
        UNION ALL {same})
)"""


def _pearson() -> str:
    return _pairs("pearson", lambda a, b: f"SELECT corr({a}, {b}) FROM feat")


def _spearman() -> str:
    """Ranks are taken on the rows where both columns are present."""
    def one(a: str, b: str) -> str:
        ranks = ", ".join(
            f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0E0 AS {name}"
            for c, name in ((a, "ra"), (b, "rb"))
        )
        return (f"SELECT corr(ra, rb) FROM (SELECT {ranks} FROM feat "
                f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
    return _pairs("spearman", one)


def _target_correlation() -> str:
    return on_features("""
SELECT p.column_a AS column_name, p.correlation AS pearson, s.correlation AS spearman
FROM pearson p JOIN spearman s ON p.column_a = s.column_a AND p.column_b = s.column_b
WHERE p.column_b = 'Churn_Flag'""", _pearson() + _spearman())


def _heatmap() -> str:
    cells = ", ".join(
        f"MAX(correlation) FILTER (WHERE column_b = '{c}') AS {c}" for c in S.CORRELATION_COLUMNS
    )
    return on_features(f"SELECT column_a, {cells} FROM pearson GROUP BY column_a", _pearson())


def _fences(rows: bool) -> str:
    bounds = _union([
        f"SELECT '{f}' AS Feature, quantile_cont(CAST({f} AS DOUBLE), 0.25) AS Q1, "
        f"quantile_cont(CAST({f} AS DOUBLE), 0.75) AS Q3 FROM feat" for f in S.OUTLIER_FEATURES
    ])
    values = _union([
        f"SELECT customerID, '{f}' AS Feature, CAST({f} AS DOUBLE) AS value FROM feat"
        for f in S.OUTLIER_FEATURES
    ])
    more = f""", b AS (
  SELECT *, Q3 - Q1 AS IQR, Q1 - 1.5E0 * (Q3 - Q1) AS lo, Q3 + 1.5E0 * (Q3 - Q1) AS hi FROM (
{bounds})
), vals AS (
{values}
)"""
    if rows:
        return on_features(f"""
SELECT customerID, Feature, value, {six_places('lo')} AS Lower_Bound, {six_places('hi')} AS Upper_Bound
FROM vals JOIN b USING (Feature) WHERE value < lo OR value > hi""", more)
    return on_features(f"""
SELECT Feature, {six_places('ANY_VALUE(Q1)')} AS Q1, {six_places('ANY_VALUE(Q3)')} AS Q3,
       {six_places('ANY_VALUE(IQR)')} AS IQR, {six_places('ANY_VALUE(lo)')} AS Lower_Bound,
       {six_places('ANY_VALUE(hi)')} AS Upper_Bound,
       COUNT(*) FILTER (WHERE value < lo OR value > hi) AS Outlier_Count
FROM vals JOIN b USING (Feature) GROUP BY Feature""", more)


def _describe() -> str:
    numeric = ("SeniorCitizen", "tenure", "MonthlyCharges")

    def one(c: str) -> str:
        if c in numeric:
            v = f"CAST({c} AS DOUBLE)"
            quartiles = ", ".join(
                f"{six_places(f'quantile_cont({v}, {p})')} AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75)
            )
            return f"""SELECT '{c}' AS column_name, COUNT({c}) AS "count",
  CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq,
  {six_places(f'AVG({c})')} AS "mean", {sig(f'stddev_samp({c})')} AS std, MIN({v}) AS "min", {quartiles},
  MAX({v}) AS "max" FROM subscribers_raw"""
        best = (f"(SELECT {{}} FROM (SELECT {c} AS v, COUNT(*) AS n FROM subscribers_raw "
                f"WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)")
        nothing = ", ".join(
            f'CAST(NULL AS DOUBLE) AS "{x}"'
            for x in ("mean", "std", "min", "p25", "p50", "p75", "max")
        )
        return (f"SELECT '{c}' AS column_name, COUNT({c}) AS \"count\", "
                f"COUNT(DISTINCT {c}) AS \"unique\", {best.format('v')} AS top, "
                f"{best.format('n')} AS freq, {nothing} FROM subscribers_raw")
    return on_raw(_union([one(c) for c in S.RAW_COLUMNS]))


def _per_raw_column(figure: str, out: str, source: str = "subscribers_raw") -> str:
    return on_raw(_union([
        f"SELECT '{c}' AS column_name, {figure.format(c=c)} AS {out} FROM {source}"
        for c in S.RAW_COLUMNS
    ]))


_NUMBERS = "TRY_CAST(TRIM(TotalCharges) AS DOUBLE)"
_DUPLICATES = ("(SELECT COUNT(*) FROM subscribers_raw) "
               "- (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM subscribers_raw))")


def _profile() -> dict[str, str]:
    types = {"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"}
    cases = " ".join(f"WHEN '{c}' THEN '{types.get(c, 'string')}'" for c in S.RAW_COLUMNS)
    counts = _per_raw_column("COUNT({c})", "non_null")
    return {
        "profile_shape": on_raw(
            f"SELECT COUNT(*) AS n_rows, {len(S.RAW_COLUMNS)} AS n_columns, "
            f"'{RAW}' AS column_names FROM subscribers_raw"
        ),
        "profile_sample": on_raw(
            f"SELECT {RAW} FROM subscribers ORDER BY md5('{S.RANDOM_SEED}:' || customerID), customerID LIMIT 5"),
        "profile_head": on_raw(f"SELECT {RAW} FROM subscribers ORDER BY customerID LIMIT 5"),
        "profile_tail": on_raw(f"SELECT {RAW} FROM subscribers ORDER BY customerID DESC LIMIT 5"),
        "profile_schema":
            f"SELECT column_name, CASE column_name {cases} END AS dtype, non_null FROM ({counts})",
        "profile_describe": _describe(),
        "profile_nunique": _per_raw_column("COUNT(DISTINCT {c})", "n_unique"),
        "missing_by_column": _per_raw_column(
            "COUNT(*) FILTER (WHERE {c} IS NULL)", "missing",
            f"(SELECT * REPLACE ({_NUMBERS} AS TotalCharges) FROM subscribers_raw)",
        ),
        "duplicate_rows": on_raw(f"SELECT CAST({_DUPLICATES} AS BIGINT) AS duplicate_rows"),
    }


def _cleaning() -> dict[str, str]:
    renamed = ", ".join(
        {"customerID": "customerID AS customer_ID", "tenure": "tenure AS tenure_months"}.get(c, c)
        for c in S.RAW_COLUMNS
    )
    trimmed = ", ".join(
        c if c in ("SeniorCitizen", "tenure", "MonthlyCharges") else f"TRIM({c}) AS {c}"
        for c in S.RAW_COLUMNS
    )
    return {
        "clean_column_names": on_raw(f"SELECT {renamed} FROM subscribers"),
        "clean_trim_strings": on_raw(f"SELECT {trimmed} FROM subscribers_raw"),
        "clean_to_numeric": on_raw(
            f"SELECT * REPLACE ({_NUMBERS} AS TotalCharges) FROM subscribers_raw"
        ),
        "clean_drop_duplicates": on_raw("SELECT DISTINCT * FROM subscribers_raw"),
        "clean_fill_total": on_raw(
            f"SELECT customerID, COALESCE({_NUMBERS}, MonthlyCharges * tenure, 0.0E0) "
            "AS TotalCharges FROM subscribers"
        ),
        "clean_map_flag": on_features(
            "SELECT customerID, Churn_Flag, SeniorCitizen_Label FROM clean"
        ),
        "clean_pipeline": on_features("SELECT * FROM clean"),
    }


def _features() -> dict[str, str]:
    def pick(*columns: str) -> str:
        return on_features(f"SELECT customerID, {', '.join(columns)} FROM feat")
    return {
        "bucket_fixed": pick(*S.BINS),
        "bucket_quantile": pick("Estimated_LTV", "Customer_Value_Band"),
        "derive_arithmetic": pick("Tenure_Year", "Annual_Revenue", "Estimated_LTV"),
        "derive_conditional": pick("Revenue_Lost"),
        "count_yes": pick(*S.COUNTED_SERVICES),
        "binary_flags": pick(*S.EQUALITY_FLAGS),
        "risk_segment": pick("Risk_Segment"),
        "feature_pipeline": on_features("SELECT * FROM feat"),
    }


def _label_rows(dim: str) -> str:
    return ", ".join(f"('{label}')" for label in S.CATEGORY_LABELS[dim])


def _reports() -> dict[str, str]:
    q = {}
    for d in S.SEGMENT_DIMS:
        q[f"segment_analysis_{d}"] = _segment_analysis(d)
        q[f"churn_rate_by_{d}"] = _churn_rate_by(d)
    q |= {f"segment_summary_{d}": _segment_summary(d) for d in S.SUMMARY_DIMS}
    q |= {f"business_query_{d}": _business_query(d) for d in S.BUSINESS_DIMS}
    for i, d in enumerate(S.METRIC_DIMS):
        m = S.METRICS[i % len(S.METRICS)]
        q[f"metric_summary_{d}_{m}"] = _metric_summary(d, m)
    for d in S.EDA_DIMS:
        q[f"crosstab_pct_{d}"] = _crosstab(d, "100.0E0", ("No", "Yes"), "Churn = 'Yes'")
        q[f"count_by_hue_{d}"] = _count_by_hue(d)
    q |= {f"contingency_counts_{d}": _contingency(d) for d in S.CHI_SQUARE_DIMS}
    q |= {f"distribution_stats_{m}": _distribution([m]) for m in S.METRICS}
    q |= {f"welch_t_{f}": _welch([f]) for f in S.TEST_FEATURES}
    q |= {f"mann_whitney_{f}": _mann_whitney([f]) for f in S.TEST_FEATURES}
    q |= {f"chi_square_{d}": _chi_square([d]) for d in S.CHI_SQUARE_DIMS}
    q = {name.lower(): text for name, text in q.items()}
    q |= {
        "chart_table_sink": _churn_rate_by("Contract"),
        "metric_summary_all": _metric_summaries(S.METRIC_DIMS, S.METRICS, "*"),
        "metric_rank": _metric_summaries(S.METRIC_DIMS, S.METRICS,
                                         'dim, dim_value, metric, "mean", metric_rank'),
        "share_of_total": _metric_summaries(S.METRIC_DIMS, S.METRICS,
                                            'dim, dim_value, metric, "sum", share_of_total'),
        "churn_rate_by_empty_labels": on_features(f"""
SELECT Tenure_Group, AVG(Churn_Flag) * 100 AS churn_rate
FROM (VALUES {_label_rows('Tenure_Group')}) every(Tenure_Group)
LEFT JOIN (SELECT {_SCATTERED} AS Tenure_Group, Churn_Flag FROM feat) USING (Tenure_Group)
GROUP BY Tenure_Group"""),
        "metric_summary_all_empty_labels": on_features(f"""
SELECT 'Tenure_Group' AS dim, Tenure_Group AS dim_value, 'MonthlyCharges' AS metric, COUNT(v) AS "count",
       {sig('COALESCE(SUM(v), 0)')} AS "sum", {sig('AVG(v)')} AS "mean", {six_places('quantile_cont(v, 0.5)')} AS median,
       MIN(v) AS "min", MAX(v) AS "max", {sig('stddev_samp(v)')} AS std,
       {sig('COALESCE(SUM(v), 0) / SUM(COALESCE(SUM(v), 0)) OVER ()')} AS share_of_total,
       CASE WHEN AVG(v) IS NOT NULL THEN DENSE_RANK() OVER (ORDER BY AVG(v) DESC NULLS LAST)::INT END AS metric_rank
FROM (VALUES {_label_rows('Tenure_Group')}) every(Tenure_Group)
LEFT JOIN (SELECT {_SCATTERED} AS Tenure_Group, MonthlyCharges AS v FROM feat) USING (Tenure_Group)
GROUP BY Tenure_Group"""),
        "crosstab_fraction": _crosstab("Contract", "1.0E0", ("retained", "churned"),
                                       "Churn_Flag = 1"),
        "core_kpis": _kpis(),
        "business_report": on_features(_REPORT),
        "probabilities": _probabilities(),
        "class_distribution": on_features(
            "SELECT Churn_Flag, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS proportion "
            "FROM feat GROUP BY Churn_Flag"
        ),
        "distribution_stats": _distribution(S.METRICS),
        "sort_by_rate": _churn_rate_by("tenure"),
        "average_rank": on_features("""
SELECT DISTINCT MonthlyCharges, COUNT(*) OVER (PARTITION BY MonthlyCharges) AS n,
       RANK() OVER (ORDER BY MonthlyCharges)
         + (COUNT(*) OVER (PARTITION BY MonthlyCharges) - 1) / 2.0E0 AS avg_rank
FROM feat WHERE MonthlyCharges IS NOT NULL"""),
        "welch_t": _welch(S.TEST_FEATURES),
        "mann_whitney": _mann_whitney(S.TEST_FEATURES),
        "chi_square": _chi_square(S.CHI_SQUARE_DIMS),
        "expected_counts": on_features(
            f"SELECT dim, value, flag, observed, {sig('expected')} AS expected FROM cells",
            _cells(S.CHI_SQUARE_DIMS),
        ),
        "pearson_matrix": on_features("SELECT * FROM pearson", _pearson()),
        "spearman_matrix": on_features("SELECT * FROM spearman", _spearman()),
        "target_correlation": _target_correlation(),
        "correlation_heatmap_data": _heatmap(),
        "iqr_outliers": _fences(rows=False),
        "iqr_outlier_rows": _fences(rows=True),
    }
    return q


def _sql_reports() -> dict[str, str]:
    exact = "CAST(TRY_CAST(TotalCharges AS DECIMAL(10,2)) AS DOUBLE) AS TotalCharges"
    revenue = sig("SUM(MonthlyCharges)")
    return {name: on_raw(text) for name, text in {
        "sql_scan_all": f"SELECT {RAW} FROM subscribers",
        "sql_cast_in_predicate": f"SELECT customerID, {_CHURNED} AS churned FROM subscribers",
        "sql_try_cast_decimal": f"SELECT customerID, {exact} FROM subscribers",
        "sql_total_customers":
            "SELECT COUNT(DISTINCT customerID) AS total_customers FROM subscribers",
        "sql_overall_churn": f"""
SELECT COUNT(DISTINCT customerID) AS total_customers,
       CAST(SUM({_CHURNED}) AS BIGINT) AS churned_customers, {_SQL_RATE} AS churn_rate
FROM subscribers""",
        "sql_churn_by_contract": f"""
SELECT Contract, COUNT(*) AS customers, CAST(SUM({_CHURNED}) AS BIGINT) AS churned_customers,
       {_SQL_RATE} AS churn_rate, ROUND(AVG(MonthlyCharges), 2) AS avg_monthly_charges,
       {revenue} AS monthly_revenue
FROM subscribers GROUP BY Contract ORDER BY churn_rate DESC, Contract""",
        "sql_churn_by_payment": f"""
SELECT PaymentMethod, COUNT(*) AS customers, CAST(SUM({_CHURNED}) AS BIGINT) AS churned_customers,
       {_SQL_RATE} AS churn_rate
FROM subscribers GROUP BY PaymentMethod ORDER BY churn_rate DESC, PaymentMethod""",
        "sql_churn_by_internet": f"""
SELECT InternetService, COUNT(*) AS customers, {_SQL_RATE} AS churn_rate
FROM subscribers GROUP BY InternetService ORDER BY churn_rate DESC, InternetService""",
        "sql_churn_by_contract_payment": f"""
SELECT Contract, PaymentMethod, COUNT(*) AS customers, {_SQL_RATE} AS churn_rate
FROM subscribers GROUP BY Contract, PaymentMethod
ORDER BY churn_rate DESC, Contract, PaymentMethod""",
        "sql_risk_ranking": f"""
SELECT *, RANK() OVER (ORDER BY churn_rate DESC)::INT AS risk_rank
FROM (SELECT Contract, PaymentMethod, COUNT(*) AS customers,
             CAST(SUM({_CHURNED}) AS DOUBLE) / COUNT(*) AS churn_rate
      FROM subscribers GROUP BY Contract, PaymentMethod)
ORDER BY risk_rank, Contract, PaymentMethod""",
        "sql_top_churned": f"""
SELECT customerID, Contract, tenure, MonthlyCharges, {exact}, Churn
FROM subscribers WHERE CAST(Churn AS VARCHAR(3)) IN ('Yes', '1')
ORDER BY MonthlyCharges DESC NULLS LAST, customerID LIMIT 100""",
    }.items()}


def _reweighted(columns: list[str], steps: int = 9, penalty: str = "1.0E0") -> str:
    """Newton's steps for a logistic regression, one after the other. Each takes the
    weighted products of the columns from the table and eliminates by hand."""
    names = ["intercept", *columns]
    k = range(len(names))
    more = [f"data AS (SELECT Churn_Flag AS y, 1.0E0 AS x0, "
            + ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(columns, 1)) + " FROM feat)",
            "b0 AS (SELECT " + ", ".join(f"0.0E0 AS b{i}" for i in k) + ")"]
    for step in range(1, steps + 1):
        score = " + ".join(f"b{i} * x{i}" for i in k)
        more.append(f"p{step} AS (SELECT *, 1 / (1 + exp(-({score}))) AS p FROM data, b{step - 1})")
        ridge = ["0.0E0", *[penalty for _ in columns]]
        cells = [f"SUM(x{i} * x{j} * p * (1 - p))" + (f" + {ridge[i]}" if i == j else "") + f" AS a{i}{j}"
                 for i in k for j in k]
        slopes = [f"SUM(x{i} * (y - p)) - {ridge[i]} * ANY_VALUE(b{i}) AS a{i}{len(names)}" for i in k]
        old = [f"ANY_VALUE(b{i}) AS b{i}" for i in k]
        more.append(f"m{step}_0 AS (SELECT {', '.join(cells + slopes + old)} FROM p{step})")
        width = range(len(names) + 1)
        for pivot in k:
            row = [f"a{i}{j} - a{i}{pivot} / a{pivot}{pivot} * a{pivot}{j} AS a{i}{j}" if i != pivot else f"a{i}{j}"
                   for i in k for j in width]
            more.append(f"m{step}_{pivot + 1} AS (SELECT {', '.join(row)}, {', '.join(f'b{i}' for i in k)} "
                        f"FROM m{step}_{pivot})")
        solved = [f"b{i} + a{i}{len(names)} / a{i}{i} AS b{i}" for i in k]
        more.append(f"b{step} AS (SELECT {', '.join(solved)} FROM m{step}_{len(names)})")
    rows = _union([
        f"SELECT '{name}' AS term, {eight_places(f'b{i}')} AS coefficient, {eight_places(f'exp(b{i})')} AS odds_ratio "
        f"FROM b{steps}" for i, name in enumerate(names)
    ])
    return on_features(rows, ", " + ", ".join(more))


def _rule_metrics() -> dict[str, str]:
    score = ("(MonthlyCharges / 130.0E0 + CASE WHEN Contract = 'Month-to-month' THEN 0.5E0 ELSE 0.0E0 END) / 1.5E0")
    rule = f""", s AS (SELECT CAST(Churn_Flag AS INT) AS y, {score} AS score FROM feat),
p AS (SELECT y, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS h,
             RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0E0 AS r FROM s),
c AS (SELECT CAST(SUM(y * h) AS DOUBLE) AS tp, CAST(SUM((1 - y) * h) AS DOUBLE) AS fp,
             CAST(SUM(y * (1 - h)) AS DOUBLE) AS fn, CAST(SUM((1 - y) * (1 - h)) AS DOUBLE) AS tn,
             SUM(y * r) AS ranks FROM p),
k AS (SELECT label, COALESCE(hit / NULLIF(called, 0), 0) AS a, COALESCE(hit / NULLIF(support, 0), 0) AS b,
             COALESCE(2 * hit / NULLIF(called + support, 0), 0) AS f, support, hit
      FROM (SELECT '0' AS label, tn AS hit, tn + fn AS called, tn + fp AS support FROM c
            UNION ALL SELECT '1', tp, tp + fp, tp + fn FROM c))"""
    twice = """, twice AS (SELECT * FROM feat UNION ALL
  SELECT * REPLACE (CASE WHEN CAST(customerID AS INT) % 8 = 0 THEN 'Two year' ELSE Contract END AS Contract)
  FROM feat WHERE CAST(customerID AS INT) % 4 = 0)"""
    metrics = _union([f"SELECT Contract, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM feat" for m in S.METRICS])
    e = eight_places
    weighted = ", ".join(f"{e(f'SUM({x} * support) / SUM(support)')}" for x in "abf")
    return {
        "classification_metrics": on_features(f"""
SELECT 'rule' AS model, {e('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy,
       {e('COALESCE(tp / NULLIF(tp + fp, 0), 0)')} AS "precision", {e('COALESCE(tp / NULLIF(tp + fn, 0), 0)')} AS recall,
       {e('COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0)')} AS f1,
       {e('(ranks - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn))')} AS roc_auc
FROM c""", rule),
        "classification_report": on_features(f"""
SELECT label, {e('a')} AS "precision", {e('b')} AS recall, {e('f')} AS f1, CAST(support AS BIGINT) AS support FROM k
UNION ALL SELECT 'accuracy', {e('SUM(hit) / SUM(support)')}, {e('SUM(hit) / SUM(support)')},
       {e('SUM(hit) / SUM(support)')}, CAST(SUM(support) AS BIGINT) FROM k
UNION ALL SELECT 'macro avg', {e('AVG(a)')}, {e('AVG(b)')}, {e('AVG(f)')}, CAST(SUM(support) AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', {weighted}, CAST(SUM(support) AS BIGINT) FROM k""", rule),
        "confusion_matrix": on_features(
            "SELECT y AS actual, h AS predicted, COUNT(*) AS n FROM p GROUP BY y, h", rule),
        "cluster_summary": on_features(f"""
SELECT CASE WHEN tenure <= 24 THEN 0 WHEN tenure <= 48 THEN 1 ELSE 2 END AS Customer_Cluster,
       COUNT(DISTINCT customerID) AS Customers, {mean('tenure')} AS Avg_Tenure,
       {mean('MonthlyCharges')} AS Avg_MonthlyCharges, {mean('TotalCharges')} AS Avg_TotalCharges,
       {mean('Service_Count')} AS Avg_Service_Count, {_RATE} AS Churn_Rate, {total('Revenue_Lost')} AS Revenue_Lost
FROM feat GROUP BY 1"""),
        "report_json_fields": on_features(_REPORT),
        "scan_rescued": on_raw(f"SELECT {RAW} FROM subscribers WHERE CAST(customerID AS INT) % 10 NOT IN (1, 2, 3)"),
        "scan_rescued_reasons": on_raw(f"""
SELECT CASE CAST(customerID AS INT) % 10 WHEN 1 THEN 'too few fields: {len(S.RAW_COLUMNS) - 1}'
            WHEN 2 THEN 'too many fields: {len(S.RAW_COLUMNS) + 1}' WHEN 3 THEN 'broken quotes' ELSE 'kept' END AS reason,
       COUNT(*) AS n FROM subscribers GROUP BY 1"""),
        "report_versions": _churn_rate_by("Contract"),
        "report_parts": on_features("""
SELECT CAST(CAST(customerID AS INT) % 4 AS INT) AS part, Contract,
       COUNT(*) + CASE WHEN CAST(customerID AS INT) % 4 = 1 THEN 1000 ELSE 0 END AS n
FROM feat GROUP BY CAST(customerID AS INT) % 4, Contract"""),
        "quantiles_merged": on_features(f"""
SELECT Contract, metric, n, {', '.join(six_places(f"MAX(CASE WHEN i = GREATEST(1, CAST(CEIL(n * {p}E-2) AS BIGINT)) THEN v END)")
                                       + f' AS p{p}' for p in (5, 25, 50, 75, 95))}
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY Contract, metric ORDER BY v) AS i,
             COUNT(*) OVER (PARTITION BY Contract, metric) AS n FROM ({metrics}) WHERE v IS NOT NULL)
GROUP BY Contract, metric, n"""),
        "kpi_cube_repeating": on_features(
            "SELECT Partner, Contract, gender, CAST(GROUPING(Partner, Contract, gender) AS BIGINT) AS level, "
            f"{_cards()} FROM twice GROUP BY CUBE (Partner, Contract, gender)", twice),
        "kpi_cards_repeating": on_features(
            f"SELECT {_cards()} FROM twice WHERE Partner IN ('Yes') AND Contract IN ('Month-to-month', 'One year')", twice),
    }


def _model_inputs() -> dict[str, str]:
    # Columns a model may use, in the order they appear in the feature table.
    used = [c for c in [
        *S.RAW_COLUMNS, "Tenure_Year", "Service_Count", "Support_Count", "Streaming_Count",
        *S.EQUALITY_FLAGS, "Tenure_Segment", "Charge_Segment", "Risk_Segment",
    ] if c not in S.ML_EXCLUDED]
    numeric = [c for c in used if c in ("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "Tenure_Year",
                                        "Service_Count", "Support_Count", "Streaming_Count", *S.EQUALITY_FLAGS)]
    text = [c for c in used if c not in numeric]
    gaps = ", ".join(
        f"CASE WHEN (CAST(customerID AS INT) + {i}) % 5 <> 0 THEN CAST({c} AS DOUBLE) END AS {c}"
        for i, c in enumerate(numeric)
    )
    medians = ", ".join(
        f"COALESCE({c}, (SELECT quantile_cont({c}, 0.5) FROM h)) AS {c}" for c in numeric
    )
    modes = ", ".join(
        f"COALESCE({c}, (SELECT {c} FROM h WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY COUNT(*) DESC, {c} LIMIT 1)) AS {c}" for c in text
    )
    holed = ", ".join(
        f"CASE WHEN {c} NOT IN ('No phone service', 'No internet service') THEN {c} END AS {c}" for c in text
    )
    scaled = ", ".join(
        f"ROUND((CAST({c} AS DOUBLE) - AVG({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}"
        for c in S.CLUSTER_FEATURES
    )
    texts = _union([
        f"SELECT customerID, '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM feat" for c in text
    ])
    numbers = _union([
        f"SELECT customerID, '{c}' AS feature, ROUND((CAST({c} AS DOUBLE) - (SELECT AVG({c}) FROM feat)) "
        f"/ (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM feat), 6) + 0.0E0 AS value FROM feat"
        for c in numeric
    ])
    # Exact per class: rows in the order of a digest, cut at rounded shares.
    ordered = f""", o AS (
  SELECT customerID, Churn_Flag, COUNT(*) OVER (PARTITION BY Churn_Flag) AS n_all,
         ROW_NUMBER() OVER (PARTITION BY Churn_Flag
                            ORDER BY substr(md5('{S.RANDOM_SEED}:' || customerID), 1, 15), customerID) AS i
  FROM feat
)"""
    fold = " + ".join(f"CASE WHEN i > ROUND(n_all * ({k} / 5.0E0)) THEN 1 ELSE 0 END" for k in range(1, 5))
    sizes = "(SELECT Churn_Flag, COUNT(*) AS n_all FROM feat GROUP BY Churn_Flag)"
    return {
        "ml_feature_frame": on_features(
            f"SELECT customerID, Churn_Flag, {', '.join(used)} FROM feat"
        ),
        "impute_median": on_features(
            f"SELECT customerID, {medians} FROM h", f", h AS (SELECT customerID, {gaps} FROM feat)"
        ),
        "impute_mode": on_features(
            f"SELECT customerID, {modes} FROM h", f", h AS (SELECT customerID, {holed} FROM feat)"
        ),
        "standard_scale": on_features(f"SELECT customerID, {scaled} FROM feat"),
        "one_hot": on_features(f"""
SELECT customerID, column_name, (SELECT COUNT(DISTINCT v) FROM t a WHERE a.column_name = t.column_name) AS size,
       CASE WHEN v IS NOT NULL THEN DENSE_RANK() OVER (PARTITION BY column_name ORDER BY v) END AS place
FROM t""", f", t AS ({texts})"),
        "preprocess_pipeline": on_features(
            f"SELECT customerID, t.column_name || '=' || COALESCE(v, top) AS feature, 1.0E0 AS value FROM t "
            f"JOIN (SELECT column_name, FIRST(v ORDER BY n DESC, v) AS top FROM (SELECT column_name, v, COUNT(*) AS n "
            f"FROM t WHERE v IS NOT NULL GROUP BY column_name, v) GROUP BY column_name) m "
            f"ON m.column_name = t.column_name UNION ALL {numbers}",
            f", t AS ({texts})"
        ),
        "preprocess_stored": on_features(
            f"SELECT customerID, t.column_name || '=' || COALESCE(v, top) AS feature, 1.0E0 AS value FROM t "
            f"JOIN (SELECT column_name, FIRST(v ORDER BY n DESC, v) AS top FROM (SELECT column_name, v, COUNT(*) AS n "
            f"FROM t WHERE v IS NOT NULL GROUP BY column_name, v) GROUP BY column_name) m "
            f"ON m.column_name = t.column_name UNION ALL {numbers}",
            f", t AS ({texts})"
        ),
        "stratified_split": on_features(
            "SELECT customerID, Churn_Flag, CASE WHEN i > ROUND(n_all * 0.2E0) THEN 'train' ELSE 'test' END AS part FROM o",
            ordered,
        ),
        "stratified_folds": on_features(f"SELECT customerID, Churn_Flag, CAST({fold} AS INT) AS fold FROM o", ordered),
        "reweighted_regression": _reweighted(["tenure", "MonthlyCharges", "SeniorCitizen"]),
        **_rule_metrics(),
        "stratified_split_sizes": on_features(f"""
SELECT Churn_Flag, 'test' AS part, CAST(ROUND(n_all * 0.2E0) AS BIGINT) AS n FROM {sizes}
UNION ALL
SELECT Churn_Flag, 'train', n_all - CAST(ROUND(n_all * 0.2E0) AS BIGINT) FROM {sizes}"""),
        "stratified_fold_sizes": on_features(f"""
SELECT Churn_Flag, CAST(i AS INT) AS fold,
       CAST(ROUND(n_all * ((i + 1) / 5.0E0)) - ROUND(n_all * (i / 5.0E0)) AS BIGINT) AS n
FROM {sizes}, range(5) AS r(i)"""),
    }


def _quality_and_dashboard() -> dict[str, str]:
    missing = " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in S.RAW_COLUMNS)
    negative = {
        "MonthlyCharges": "COUNT(*) FILTER (WHERE MonthlyCharges < 0)",
        "TotalCharges": f"COUNT(*) FILTER (WHERE {_NUMBERS} < 0)",
    }
    invalid = ("SELECT Churn AS invalid_value FROM subscribers_raw WHERE Churn IS NOT NULL "
               "EXCEPT SELECT v FROM (VALUES ('Yes'), ('No')) t(v)")
    checks = {
        "rows": "(SELECT COUNT(*) FROM subscribers_raw)",
        "missing_values": f"(SELECT {missing} FROM subscribers_raw)",
        "negative_charges": f"(SELECT {negative['MonthlyCharges']} FROM subscribers_raw)",
        "negative_total_charges": f"(SELECT {negative['TotalCharges']} FROM subscribers_raw)",
        "duplicates": _DUPLICATES,
        "unique_customers": "(SELECT COUNT(DISTINCT customerID) FROM subscribers_raw)",
        "invalid_target_values": f"(SELECT COUNT(*) FROM ({invalid}))",
    }
    return {
        "check_unique_customers": on_raw(
            "SELECT COUNT(DISTINCT customerID) AS unique_customers FROM subscribers_raw"
        ),
        "check_negative": on_raw(_union([
            f"SELECT '{c}' AS column_name, {n} AS negative FROM subscribers_raw"
            for c, n in negative.items()
        ])),
        "check_invalid_values": on_raw(invalid),
        "quality_report": on_raw(_union([
            f"SELECT '{name}' AS check_name, CAST({n} AS BIGINT) AS value"
            for name, n in checks.items()
        ])),
        "kpi_cards": on_features(
            f"SELECT {_cards()} FROM feat "
            "WHERE Partner IN ('Yes') AND Contract IN ('Month-to-month', 'One year')"
        ),
        "kpi_cube": on_features(
            "SELECT Partner, Contract, gender, "
            "CAST(GROUPING(Partner, Contract, gender) AS BIGINT) AS level, "
            f"{_cards()} FROM feat GROUP BY CUBE (Partner, Contract, gender)"
        ),
        "churn_by_tenure_month": _churn_rate_by("tenure"),
        "customers_by_contract": on_features(
            "SELECT Contract, COUNT(DISTINCT customerID) AS customers FROM feat GROUP BY Contract"
        ),
        "customers_by_seniorcitizen": on_features(
            "SELECT SeniorCitizen, COUNT(DISTINCT customerID) AS customers FROM feat "
            "GROUP BY SeniorCitizen"
        ),
    }


def build_oracles() -> dict[str, str]:
    scan = {"scan_subscribers": on_raw(f"SELECT {RAW} FROM subscribers")}
    return {
        **scan, **_profile(), **_cleaning(), **_features(), **_reports(), **_sql_reports(),
        **_model_inputs(), **_quality_and_dashboard(),
    }
