"""Pearson and Spearman matrices, complete pair by pair."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import without_nan
from tenura.operators.ranking import average_rank, running_counts
from tenura.sources.shared import pin
from tenura.schema import CORRELATION_COLUMNS, CUSTOMER_ID, TARGET_FLAG

PAIRS_PER_PASS = 150  # pairs of one pass over the rows

Pair = tuple[str, str]


def _pairs(columns: Sequence[str], target: str | None = None) -> list[Pair]:
    """The pairs of columns that differ, or those with the target."""
    if target is None:
        return list(combinations(columns, 2))
    return [(c, target) for c in columns if c != target]


def _correlated(df: DataFrame, pairs: Sequence[Pair]) -> dict[Pair, float | None]:
    """Correlation of each pair over the rows that have both, in one pass: a row
    becomes its pairs of values, which combine before the shuffle. NaN counts as
    missing; null for a constant column. The plan doesn't grow with the pairs."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    place, n = {c: i for i, c in enumerate(columns)}, len(columns)
    number = {place[a] * n + place[b]: (a, b) for a, b in pairs}
    if not number:
        return {}
    values = df.select(F.array(*[without_nan(F.col(c)) for c in columns]).alias("v"))
    numbers = ", ".join(map(str, number))
    both = values.select(F.expr(
        f"inline(transform(array({numbers}), p -> struct(p AS pair, v[p div {n}] AS a, v[p % {n}] AS b)))"
    )).where("a IS NOT NULL AND b IS NOT NULL")
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    rows = both.groupBy("pair").agg(F.try_divide(F.covar_pop("a", "b"), spread).alias("r")).collect()
    found = {number[row["pair"]]: row["r"] for row in rows}     # one row per pair of columns
    return {pair: None if found.get(pair) is None or found[pair] != found[pair] else found[pair] for pair in pairs}


def _varies(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    ends = [f(without_nan(F.col(c))) for c in columns for f in (F.min, F.max)]
    row = df.agg(*ends).first()
    return {c: row[2 * i] is not None and row[2 * i] < row[2 * i + 1] for i, c in enumerate(columns)}


def _matrix(df: DataFrame, columns: Sequence[str], found: dict[Pair, float | None]) -> DataFrame:
    varies = _varies(df, columns)
    cells = {(c, c): 1.0 if varies[c] else None for c in columns}
    cells |= {p: r for (a, b), r in found.items() for p in ((a, b), (b, a))}
    data = [(a, b, cells[a, b]) for a in columns for b in columns]
    return df.sparkSession.createDataFrame(
        data, "column_a string, column_b string, correlation double"
    )


def pearson_matrix(df: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """The matrix in long form: (column_a, column_b, correlation)."""
    return _matrix(df, columns, _correlated(df, _pairs(columns)))


def _missing(c: str) -> Column:
    return without_nan(F.col(c)).isNull()


def _null_classes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """For each column, the first column that is missing on the same rows; None
    for a column that is never missing."""
    row = df.agg(*[F.count_if(_missing(c)) for c in columns]).first()
    counts = dict(zip(columns, row))
    holed = [c for c in columns if counts[c]]
    alike = [(a, b) for a, b in combinations(holed, 2) if counts[a] == counts[b]]
    differ: dict[Pair, int] = {}
    for at in range(0, len(alike), PAIRS_PER_PASS):
        some = alike[at:at + PAIRS_PER_PASS]
        row = df.agg(*[F.count_if(_missing(a) != _missing(b)) for a, b in some]).first()
        differ |= dict(zip(some, row))
    first: dict[str, str | None] = {c: None if not counts[c] else c for c in columns}
    for (a, b), n in differ.items():
        if n == 0 and first[b] == b:
            first[b] = first[a]
    return first


def ranked_columns(df: DataFrame, columns: Sequence[str], key: str = CUSTOMER_ID) -> DataFrame:
    """Each column replaced by its rank with ties averaged, for a unique key.

    Ranks are computed once per distinct value and found by (column, value) for
    all columns together; a frequent value is left to the adaptive skew join.
    """
    doubles = df.select(key, *[without_nan(F.col(c)).alias(c) for c in columns])
    long = doubles.unpivot([key], list(columns), "column", "value")
    ranks = pin(average_rank(running_counts(long, ["value"], ["column"])).select(
        "column", "value", "avg_rank"), "ranks")
    placed = long.join(ranks, ["column", "value"])
    return placed.groupBy(key).pivot("column", list(columns)).agg(F.first("avg_rank"))


def _rank_correlated(df: DataFrame, pairs: Sequence[Pair], key: str) -> dict[Pair, float | None]:
    """Rank correlations; a pair is ranked over the rows that have both. Pairs
    whose columns are missing on the same rows are ranked together."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    classes = _null_classes(df, columns)
    blocks: dict[frozenset, list[Pair]] = {}
    for a, b in pairs:
        blocks.setdefault(frozenset({classes[a], classes[b]} - {None}), []).append((a, b))
    found: dict[Pair, float | None] = {}
    for holed, block in blocks.items():
        used = list(dict.fromkeys(c for pair in block for c in pair))
        rows = df
        for c in holed:
            rows = rows.where(~_missing(c))
        found |= _correlated(pin(ranked_columns(rows, used, key), "ranked"), block)
    return found


def spearman_matrix(df: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS,
                    key: str = CUSTOMER_ID) -> DataFrame:
    return _matrix(df, columns, _rank_correlated(df, _pairs(columns), key))


def target_correlation(df: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS,
                       target: str = TARGET_FLAG, key: str = CUSTOMER_ID) -> DataFrame:
    """Both correlations of every column with the target, strongest first. Only
    the pairs with the target are computed."""
    pairs = _pairs(columns, target)
    pearson, spearman = _correlated(df, pairs), _rank_correlated(df, pairs, key)
    own = 1.0 if _varies(df, [target])[target] else None
    data = [(c, pearson.get((c, target), own), spearman.get((c, target), own)) for c in columns]
    rows = df.sparkSession.createDataFrame(data, "column_name string, pearson double, spearman double")
    return rows.orderBy(F.col("pearson").desc_nulls_last(), "column_name")


def correlation_heatmap(df: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """The Pearson matrix as a wide table, the input of a heatmap."""
    return (
        pearson_matrix(df, columns).groupBy("column_a")
        .pivot("column_b", list(columns)).agg(F.first("correlation"))
    )
