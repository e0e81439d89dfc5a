"""Every operator as a named query over a data folder.

Figures that two engines add up in a different order (deviations, moments,
statistics) are rounded to ten significant digits here, not in the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura import schema as S
from tenura.functions.columns import significant
from tenura.ml import cluster, metrics, prep, reweighted, validation
from tenura.operators import (
    clean, correlation, cubes, distribution, features, hypothesis, kpis, profile, quality, ranking,
    segments, sketches,
)
from tenura.plans import sqlsuite
from tenura.plans.pipelines import clean_pipeline, feature_pipeline
from tenura.plans.workspace import Workspace, workspace
from tenura.sources import subscribers as source
from tenura.sources import versions
from tenura.sources.shared import new_path, pin

Query = Callable[[SparkSession, str], DataFrame]

CARD_FILTERS = {"Partner": ["Yes"], "Contract": ["Month-to-month", "One year"]}
REGRESSION_COLUMNS = ("tenure", "MonthlyCharges", "SeniorCitizen")
# A churn score by rule, so that metrics can be told apart from any model's fit.
RULE_SCORE = "(MonthlyCharges / 130.0E0 + CASE WHEN Contract = 'Month-to-month' THEN 0.5E0 ELSE 0.0E0 END) / 1.5E0"
RULE_CLUSTER = "CASE WHEN tenure <= 24 THEN 0 WHEN tenure <= 48 THEN 1 ELSE 2 END"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    # Amounts in cents often lie halfway between two roundings; a nudge far above
    # the noise and far below the last digit takes them to the same side everywhere.
    return df.withColumns({c: significant(F.col(c) * (1 + NUDGE)) for c in columns})


NUDGE = 1e-12
# Sums and means of amounts: exact in the operators, but not in other engines.
AMOUNTS = frozenset("""
Avg_Monthly_Charges Avg_Total_Charges Avg_Tenure Revenue_Lost Annual_Revenue Avg_Monthly_Charge Avg_LTV
monthly_revenue annual_revenue revenue_lost average_tenure average_monthly_charge average_ltv avg_monthly_charges
sum mean
""".split())


def amounts(df: DataFrame) -> DataFrame:
    return rounded(df, *[c for c in df.columns if c in AMOUNTS])


def six_places(df: DataFrame, *columns: str) -> DataFrame:
    """For quantiles of amounts, which are multiples of a fraction of a cent."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def eight_places(df: DataFrame, *columns: str) -> DataFrame:
    """For figures between -1 and 1, where the noise is absolute."""
    return df.withColumns({c: F.round(c, 8) + F.lit(0.0) for c in columns})


def _scan_csv(w: Workspace) -> DataFrame:
    path = new_path(w.spark, "subscribers-csv")
    source.write_csv(w.subscribers, path)
    return source.read_csv(w.spark, path)


BROKEN = """CASE CAST(customerID AS INT) % 10
    WHEN 1 THEN regexp_replace(line, ',[^,]*$', '') WHEN 2 THEN concat(line, ',more')
    WHEN 3 THEN concat('"', line) ELSE line END"""


def _rescued(w: Workspace) -> tuple[DataFrame, DataFrame]:
    """A delivery as text: some lines short, long or with a broken quote, and whole
    numbers written with a zero after the point."""
    texts = [F.concat(F.col("tenure").cast("string"), F.lit(".0")) if c == "tenure" else F.coalesce(
        F.col(c).cast("string"), F.lit("")) for c in S.RAW_COLUMNS]
    lines = w.subscribers.select("customerID", F.concat_ws(",", *texts).alias("line"))
    path = new_path(w.spark, "delivery-text")
    header = w.spark.createDataFrame([(",".join(S.RAW_COLUMNS),)], "value string")
    header.unionByName(lines.select(F.expr(BROKEN).alias("value"))).write.text(path)
    return source.rescue_csv(w.spark, path)


def _rescued_reasons(w: Workspace) -> DataFrame:
    kept, quarantined = _rescued(w)
    return quarantined.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(
        kept.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n")))


def _versioned(w: Workspace) -> DataFrame:
    path = new_path(w.spark, "report-versions")
    versions.write_version(segments.churn_rate_by(w.features, "PaymentMethod"), path)
    versions.write_version(segments.churn_rate_by(w.features, "Contract"), path)
    return versions.read_version(w.spark, path)


def _replaced_parts(w: Workspace) -> DataFrame:
    """Counts per contract and part of the customers; one part is written again."""
    path = new_path(w.spark, "report-parts")
    rows = w.features.select(F.pmod(F.col("customerID").cast("int"), F.lit(4)).alias("part"), "Contract")
    counts = rows.groupBy("part", "Contract").agg(F.count(F.lit(1)).alias("n"))
    versions.write_parts(counts, path, ["part"])
    versions.write_parts(counts.where("part = 1").withColumn("n", F.col("n") + 1000), path, ["part"])
    return w.spark.read.schema("Contract string, n bigint, part int").parquet(path)


def _approximate(w: Workspace) -> DataFrame:
    """Quantiles of all customers per contract, merged from the states of eight deliveries."""
    rows = w.features.withColumn("delivery", F.pmod(F.col("customerID").cast("int"), F.lit(8)))
    states = pin(sketches.quantile_states(rows, S.METRICS, ["delivery", "Contract"]), "quantile-states")
    merged = sketches.merge_states(states, ["Contract"])
    return six_places(sketches.read_quantiles(merged, ["Contract"], [0.05, 0.25, 0.5, 0.75, 0.95]),
                      "p5", "p25", "p50", "p75", "p95")


def _repeating(w: Workspace) -> DataFrame:
    """Subscribers of which some come twice, once with another contract."""
    again = w.features.where(F.col("customerID").cast("int") % 4 == 0)
    moved = F.when(F.col("customerID").cast("int") % 8 == 0, "Two year").otherwise(F.col("Contract"))
    return w.features.unionByName(again.withColumn("Contract", moved))


def _stored_preprocessing(w: Workspace) -> DataFrame:
    frame = prep.ml_feature_frame(w.features)
    path = new_path(w.spark, "preprocessor")
    prep.Preprocessor(*prep.feature_types(frame)).fit(frame).write().save(path)
    return _feature_values(prep.PreprocessorModel.load(path), frame)


def _chart_table(w: Workspace) -> DataFrame:
    path = new_path(w.spark, "chart-churn-by-contract")
    source.write_report(segments.churn_rate_by(w.features, "Contract"), path)
    return w.spark.read.parquet(path)


def _messy_headers(w: Workspace) -> DataFrame:
    messy = w.subscribers.withColumnsRenamed(
        {"customerID": " customer ID", "tenure": "tenure-months "}
    )
    return clean.clean_column_names(messy)


def _average_rank(w: Workspace) -> DataFrame:
    counts = ranking.running_counts(w.features, ["MonthlyCharges"])
    return ranking.average_rank(counts).select("MonthlyCharges", "n", "avg_rank")


def _impute_median(w: Workspace) -> DataFrame:
    frame = prep.ml_feature_frame(w.features)
    numeric, _ = prep.feature_types(frame)
    holed = frame.select("customerID", *[
        F.expr(f"CASE WHEN (CAST(customerID AS INT) + {i}) % 5 <> 0 THEN `{c}` END").alias(c) for i, c in enumerate(numeric)
    ])
    filled = prep.impute(holed, prep.fit_medians(holed, numeric))
    return filled.select("customerID", *[F.col(c).cast("double").alias(c) for c in numeric])


def _impute_mode(w: Workspace) -> DataFrame:
    frame = prep.ml_feature_frame(w.features)
    _, categorical = prep.feature_types(frame)
    holed = frame.select("customerID", *[
        F.when(~F.col(c).isin("No phone service", "No internet service"), F.col(c)).alias(c) for c in categorical
    ])
    return prep.impute(holed, prep.fit_modes(holed, categorical))


def _standard_scale(w: Workspace) -> DataFrame:
    columns = list(S.CLUSTER_FEATURES)
    frame = w.features.select("customerID", *columns)
    scaled = prep.standard_scale(frame, prep.fit_scales(frame, columns))
    return scaled.select("customerID", *[F.round(c, 6).alias(c) for c in columns])


def _one_hot(w: Workspace) -> DataFrame:
    """The place of the one in each column's vector, and the vector's length."""
    frame = prep.ml_feature_frame(w.features)
    _, categorical = prep.feature_types(frame)
    encoded = Pipeline(stages=prep.one_hot(categorical)).fit(frame).transform(frame)
    hot = [F.struct(F.lit(c).alias("column_name"), vector_to_array(f"{c}_onehot").alias("v")) for c in categorical]
    return encoded.select("customerID", F.inline(F.array(*hot))).select(
        "customerID", "column_name", F.size("v").cast("bigint").alias("size"),
        F.nullif(F.array_position("v", 1.0), F.lit(0)).cast("bigint").alias("place"),
    )


def _preprocessed(w: Workspace) -> DataFrame:
    """Every number and every one that is set in the vectors, by name."""
    frame = prep.ml_feature_frame(w.features)
    return _feature_values(prep.Preprocessor(*prep.feature_types(frame)).fit(frame), frame)


def _feature_values(model: prep.PreprocessorModel, frame: DataFrame) -> DataFrame:
    names, n = model.feature_names(), len(model.numeric)
    values = model.transform(frame).select("customerID", F.posexplode(vector_to_array("features")).alias("i", "v"))
    named = values.where((F.col("i") < n) | (F.col("v") != 0))
    return named.select("customerID", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("i") + 1).alias("feature"),
                        (F.round("v", 6) + F.lit(0.0)).alias("value"))


def _rule_predictions(w: Workspace) -> DataFrame:
    """The rule's calls. A customer without charges has no score and is called 0; like
    the SQL, which sorts nulls last, the area ranks such customers above all others."""
    rows = w.features.select("customerID", "Churn_Flag", F.expr(RULE_SCORE).alias("score"))
    called = F.coalesce(F.col("score") > 0.5, F.lit(False))
    return rows.withColumn("prediction", called.cast("double")).withColumn(
        "score", F.coalesce("score", F.lit(float("inf")))).select(
        "customerID", "Churn_Flag", "prediction",
        array_to_vector(F.array(1 - F.col("score"), F.col("score"))).alias("probability"),
    )


def _scattered_labels(w: Workspace) -> DataFrame:
    """All rows in the first and the last tenure group: the others are empty."""
    first, last = S.CATEGORY_LABELS["Tenure_Group"][0], S.CATEGORY_LABELS["Tenure_Group"][-1]
    return w.features.withColumn("Tenure_Group", F.when(F.col("tenure") <= 24, first).otherwise(last))


def _report_fields(w: Workspace) -> DataFrame:
    report = kpis.business_report(w.features, w.unique_ids)
    schema = ", ".join(f"{name} {kind}" for name, kind in report.dtypes)
    return amounts(kpis.report_fields(kpis.report_json(report), schema))


def _split(w: Workspace) -> DataFrame:
    train, test = prep.stratified_split(prep.ml_feature_frame(w.features))
    return train.select("customerID", "Churn_Flag", F.lit("train").alias("part")).unionByName(
        test.select("customerID", "Churn_Flag", F.lit("test").alias("part"))
    )


def _split_sizes(w: Workspace) -> DataFrame:
    return _split(w).groupBy("Churn_Flag", "part").agg(F.count(F.lit(1)).alias("n"))


def _folds(w: Workspace) -> DataFrame:
    return prep.stratified_folds(w.features.select("customerID", "Churn_Flag"))


def _fold_sizes(w: Workspace) -> DataFrame:
    return _folds(w).groupBy("Churn_Flag", "fold").agg(F.count(F.lit(1)).alias("n"))


def _clusters(w: Workspace) -> DataFrame:
    return cluster.kmeans_assign(w.features)


def _slug(name: str) -> str:
    return name.lower()


def _builders() -> dict[str, Callable[[Workspace], DataFrame]]:
    q: dict[str, Callable[[Workspace], DataFrame]] = {}

    # sources and sinks
    q["scan_subscribers"] = _scan_csv
    q["report_json"] = lambda w: kpis.report_json(kpis.business_report(w.features, w.unique_ids))
    q["report_json_fields"] = _report_fields
    q["scan_rescued"] = lambda w: source.as_declared(_rescued(w)[0])
    q["scan_rescued_reasons"] = _rescued_reasons
    q["report_versions"] = _versioned
    q["report_parts"] = _replaced_parts
    q["quantiles_merged"] = _approximate
    q["kpi_cube_repeating"] = lambda w: amounts(cubes.cube_from_states(cubes.kpi_states(_repeating(w))))
    q["kpi_cards_repeating"] = lambda w: amounts(
        cubes.cards_from_states(cubes.kpi_states(_repeating(w)), CARD_FILTERS))
    q["preprocess_stored"] = _stored_preprocessing
    q["chart_table_sink"] = _chart_table

    # profiling, on the raw delivery
    q["profile_shape"] = lambda w: profile.profile_shape(w.raw)
    q["profile_head"] = lambda w: profile.profile_head(w.subscribers)
    q["profile_tail"] = lambda w: profile.profile_tail(w.subscribers)
    q["profile_sample"] = lambda w: profile.profile_sample(w.subscribers)
    q["profile_schema"] = lambda w: profile.profile_schema(w.raw)
    q["profile_describe"] = lambda w: six_places(
        rounded(profile.profile_describe(w.raw), "std"), "mean", "p25", "p50", "p75"
    )
    q["profile_nunique"] = lambda w: profile.profile_nunique(w.raw)
    q["missing_by_column"] = lambda w: quality.missing_by_column(clean.coerce_numbers(w.raw))
    q["duplicate_rows"] = lambda w: quality.duplicate_rows(w.raw)

    # cleaning
    q["clean_column_names"] = _messy_headers
    q["clean_trim_strings"] = lambda w: clean.trim_strings(w.raw)
    q["clean_to_numeric"] = lambda w: clean.coerce_numbers(w.raw)
    q["clean_drop_duplicates"] = lambda w: clean.drop_duplicates(w.raw)
    q["clean_fill_total"] = lambda w: clean.fill_total(
        clean.coerce_numbers(w.subscribers)
    ).select("customerID", "TotalCharges")
    q["clean_map_flag"] = lambda w: clean.map_flags(w.subscribers).select(
        "customerID", "Churn_Flag", "SeniorCitizen_Label"
    )
    q["clean_pipeline"] = lambda w: clean_pipeline(w.raw)

    # features
    q["bucket_fixed"] = lambda w: features.bucket_fixed(w.clean).select("customerID", *S.BINS)
    q["bucket_quantile"] = lambda w: features.bucket_quantile(
        features.derive_arithmetic(w.clean)
    ).select("customerID", "Estimated_LTV", "Customer_Value_Band")
    q["derive_arithmetic"] = lambda w: features.derive_arithmetic(w.clean).select(
        "customerID", "Tenure_Year", "Annual_Revenue", "Estimated_LTV"
    )
    q["derive_conditional"] = lambda w: features.derive_revenue_lost(w.clean).select(
        "customerID", "Revenue_Lost"
    )
    q["count_yes"] = lambda w: features.count_services(w.clean).select(
        "customerID", *S.COUNTED_SERVICES
    )
    q["binary_flags"] = lambda w: features.binary_flags(w.clean).select(
        "customerID", *S.EQUALITY_FLAGS
    )
    q["risk_segment"] = lambda w: features.risk_segment(w.clean).select(
        "customerID", "Risk_Segment"
    )
    q["feature_pipeline"] = lambda w: feature_pipeline(w.clean, w.value_edges)

    # reports, one entry per dimension the analysis uses
    for d in S.SEGMENT_DIMS:
        q[f"segment_analysis_{_slug(d)}"] = (
            lambda w, d=d: amounts(segments.segment_analysis(w.features, d, w.unique_ids))
        )
        q[f"churn_rate_by_{_slug(d)}"] = lambda w, d=d: segments.churn_rate_by(w.features, d)
    for d in S.SUMMARY_DIMS:
        q[f"segment_summary_{_slug(d)}"] = (
            lambda w, d=d: amounts(segments.segment_summary(w.features, d, w.unique_ids))
        )
    for d in S.BUSINESS_DIMS:
        q[f"business_query_{_slug(d)}"] = (
            lambda w, d=d: amounts(segments.business_query(w.features, d, w.unique_ids))
        )
    for i, d in enumerate(S.METRIC_DIMS):
        m = S.METRICS[i % len(S.METRICS)]
        q[f"metric_summary_{_slug(d)}_{_slug(m)}"] = lambda w, d=d, m=m: _summary(
            segments.metric_summary(w.features, d, m)
        )
    q["metric_summary_all"] = lambda w: _summary(segments.metric_summary_all(w.features))
    for d in S.EDA_DIMS:
        q[f"crosstab_pct_{_slug(d)}"] = lambda w, d=d: segments.crosstab_pct(w.features, d)
        q[f"count_by_hue_{_slug(d)}"] = lambda w, d=d: segments.count_by_hue(w.features, d)
    q["crosstab_fraction"] = lambda w: segments.crosstab_pct(
        w.features, "Contract", "Churn_Flag", {0: "retained", 1: "churned"}, 1.0
    )
    for d in S.CHI_SQUARE_DIMS:
        q[f"contingency_counts_{_slug(d)}"] = (
            lambda w, d=d: segments.contingency_counts(w.features, d)
        )
    q["core_kpis"] = lambda w: rounded(kpis.core_kpis(w.features, w.unique_ids), "value")
    q["business_report"] = lambda w: amounts(kpis.business_report(w.features, w.unique_ids))
    q["probabilities"] = lambda w: rounded(kpis.probabilities(w.features), "value")
    q["class_distribution"] = lambda w: segments.class_distribution(w.features)
    q["distribution_stats"] = lambda w: _statistics(distribution.distribution_stats(w.features))
    for m in S.METRICS:
        q[f"distribution_stats_{_slug(m)}"] = lambda w, m=m: _statistics(
            distribution.distribution_stats(w.features, [m])
        )
    q["sort_by_rate"] = lambda w: ranking.sort_by_rate(
        segments.churn_rate_by(w.features, "tenure"), "churn_rate", "tenure"
    )
    q["metric_rank"] = lambda w: amounts(segments.metric_summary_all(w.features).select(
        "dim", "dim_value", "metric", "mean", "metric_rank"
    ))
    q["share_of_total"] = lambda w: rounded(segments.metric_summary_all(w.features).select(
        "dim", "dim_value", "metric", "sum", "share_of_total"
    ), "sum", "share_of_total")
    q["churn_rate_by_empty_labels"] = lambda w: segments.churn_rate_by(
        _scattered_labels(w), "Tenure_Group"
    )
    q["metric_summary_all_empty_labels"] = lambda w: _summary(segments.metric_summary_all(
        _scattered_labels(w), ["Tenure_Group"], ["MonthlyCharges"]
    ))
    q["average_rank"] = _average_rank

    # the SQL reports
    for name in sqlsuite.QUERIES:
        q[name] = lambda w, name=name: amounts(_decimals_as_doubles(sqlsuite.run(name, w.subscribers)))

    # tests and correlation
    q["welch_t"] = lambda w: _welch(w, S.TEST_FEATURES)
    q["mann_whitney"] = lambda w: _mann_whitney(w, S.TEST_FEATURES)
    for f in S.TEST_FEATURES:
        q[f"welch_t_{_slug(f)}"] = lambda w, f=f: _welch(w, [f])
        q[f"mann_whitney_{_slug(f)}"] = lambda w, f=f: _mann_whitney(w, [f])
    q["chi_square"] = lambda w: _chi_square(w, S.CHI_SQUARE_DIMS)
    for d in S.CHI_SQUARE_DIMS:
        q[f"chi_square_{_slug(d)}"] = lambda w, d=d: _chi_square(w, [d])
    q["welch_t_p_values"] = lambda w: hypothesis.welch_t(w.features)
    q["mann_whitney_p_values"] = lambda w: hypothesis.mann_whitney(w.features)
    q["chi_square_p_values"] = lambda w: hypothesis.chi_square(w.features)
    q["expected_counts"] = lambda w: rounded(hypothesis.expected_counts(w.features).select(
        "dim", "value", "flag", "observed", "expected"
    ), "expected")
    q["pearson_matrix"] = lambda w: eight_places(
        correlation.pearson_matrix(w.features), "correlation"
    )
    q["spearman_matrix"] = lambda w: eight_places(
        correlation.spearman_matrix(w.features), "correlation"
    )
    q["target_correlation"] = lambda w: eight_places(
        correlation.target_correlation(w.features), "pearson", "spearman"
    )
    q["correlation_heatmap_data"] = lambda w: eight_places(
        correlation.correlation_heatmap(w.features), *S.CORRELATION_COLUMNS
    )
    q["iqr_outliers"] = lambda w: six_places(distribution.iqr_outliers(w.features), *_FENCES)
    q["iqr_outlier_rows"] = lambda w: six_places(
        distribution.outlier_rows(w.features), "Lower_Bound", "Upper_Bound"
    )

    # models
    q["ml_feature_frame"] = lambda w: prep.ml_feature_frame(w.features)
    q["impute_median"] = _impute_median
    q["impute_mode"] = _impute_mode
    q["standard_scale"] = _standard_scale
    q["one_hot"] = _one_hot
    q["preprocess_pipeline"] = _preprocessed
    q["stratified_split"] = _split
    q["stratified_split_sizes"] = _split_sizes
    q["stratified_folds"] = _folds
    q["stratified_fold_sizes"] = _fold_sizes
    for name in ("logistic_regression", "decision_tree", "random_forest", "gradient_boosting",
                 "extra_trees"):
        q[name] = lambda w, name=name: metrics.classification_metrics(w.predictions(name), name)
    q["reweighted_regression"] = lambda w: eight_places(reweighted.reweighted_regression(
        w.features, REGRESSION_COLUMNS), "coefficient", "odds_ratio")
    q["classification_metrics"] = lambda w: eight_places(
        metrics.classification_metrics(_rule_predictions(w), "rule"), "accuracy", "precision", "recall", "f1", "roc_auc")
    q["classification_report"] = lambda w: eight_places(
        metrics.classification_report(_rule_predictions(w)), "precision", "recall", "f1")
    q["confusion_matrix"] = lambda w: metrics.confusion_matrix(_rule_predictions(w))
    q["logistic_regression_report"] = lambda w: metrics.classification_report(w.predictions("logistic_regression"))
    q["logistic_regression_confusion"] = lambda w: metrics.confusion_matrix(w.predictions("logistic_regression"))
    q["stratified_cv"] = lambda w: validation.stratified_cv(w.features)
    q["rf_grid_search"] = lambda w: validation.rf_grid_search(w.features)
    q["kmeans_sweep"] = lambda w: cluster.kmeans_sweep(w.features)
    q["kmeans_assign"] = lambda w: _clusters(w).select("customerID", "Customer_Cluster")
    q["cluster_summary"] = lambda w: _cluster_figures(segments.cluster_summary(
        w.features.withColumn("Customer_Cluster", F.expr(RULE_CLUSTER)), w.unique_ids))
    q["cluster_summary_kmeans"] = lambda w: segments.cluster_summary(_clusters(w), w.unique_ids)
    q["pca_project"] = lambda w: cluster.pca_project(w.features)
    q["pca_variance"] = lambda w: cluster.pca_variance(w.features)

    # quality, on the raw delivery
    q["check_unique_customers"] = lambda w: quality.check_unique_customers(w.raw)
    q["check_negative"] = lambda w: quality.check_negative(w.raw)
    q["check_invalid_values"] = lambda w: quality.check_invalid_values(w.raw)
    q["quality_report"] = lambda w: quality.quality_report(w.raw)

    # dashboard
    q["kpi_cards"] = lambda w: amounts(kpis.kpi_cards(w.features, CARD_FILTERS, w.unique_ids))
    q["kpi_cube"] = lambda w: amounts(kpis.kpi_cube(w.features, unique_ids=w.unique_ids))
    q["churn_by_tenure_month"] = lambda w: kpis.churn_by_tenure_month(w.features)
    q["customers_by_contract"] = lambda w: kpis.customers_by(w.features, "Contract", w.unique_ids)
    q["customers_by_seniorcitizen"] = (
        lambda w: kpis.customers_by(w.features, "SeniorCitizen", w.unique_ids)
    )
    return q


_FENCES = ("Q1", "Q3", "IQR", "Lower_Bound", "Upper_Bound")


def _cluster_figures(df: DataFrame) -> DataFrame:
    return rounded(df, *[c for c in df.columns if c.startswith("Avg_")], "Revenue_Lost")


def _summary(df: DataFrame) -> DataFrame:
    return six_places(rounded(df, "sum", "mean", "std", "share_of_total"), "median")


def _statistics(df: DataFrame) -> DataFrame:
    moments = rounded(df, "mean", "std", "variance", "skew", "kurtosis")
    return six_places(moments, "median", "q1", "q2", "q3", "range", "iqr")


def _welch(w: Workspace, names: list[str]) -> DataFrame:
    result = hypothesis.welch_t(w.features, names, p_value=False)
    return rounded(result, "mean1", "mean0", "t_statistic", "df")


def _mann_whitney(w: Workspace, names: list[str]) -> DataFrame:
    return rounded(hypothesis.mann_whitney(w.features, names, p_value=False), "z")


def _chi_square(w: Workspace, dims: list[str]) -> DataFrame:
    return rounded(hypothesis.chi_square(w.features, dims, p_value=False), "chi2")


def _decimals_as_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(name).cast("double").alias(name) if kind.startswith("decimal") else F.col(name)
        for name, kind in df.dtypes
    ])


def build_queries() -> dict[str, Query]:
    return {
        name: (lambda spark, data_dir, build=build: build(workspace(spark, data_dir)))
        for name, build in _builders().items()
    }
