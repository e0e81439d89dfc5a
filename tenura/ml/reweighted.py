"""Logistic regression by iteratively reweighted least squares.

Each step is one aggregation over all rows, to the weighted products of the columns
(X'WX) and the slope (X'(y - p)): as many numbers for any number of rows. They
are solved for the next coefficients on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.ml.forest import feature_rows, matrix
from tenura.schema import TARGET_FLAG
from tenura.sources.shared import pin
from tenura.sources.workers import map_batches


@dataclass
class Fit:
    """Coefficients (the intercept first), the mean log loss before each step, and the
    largest change of a coefficient in the last one."""

    coefficients: np.ndarray
    losses: list[float]
    change: float


def _sums(rows: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(X'WX, X'(y - p), log loss, rows) at ``beta``."""
    k = len(beta)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            x = np.hstack([np.ones((len(x), 1)), x])
            y, score = batch.column(0).to_numpy(), x @ beta
            p = 1 / (1 + np.exp(-score))
            total[:k * k] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
            total[k * k:-2] += x.T @ (y - p)
            total[-2] += np.logaddexp(0, np.where(y == 1, -score, score)).sum()
            total[-1] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["cell", "v"])

    cells = map_batches(rows.select("label", "x"), task, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    total = np.zeros(k * k + k + 2)
    for cell, v in cells.collect():     # one per pair of columns
        total[cell] = v
    return total[:k * k].reshape(k, k), total[k * k:-2], total[-2], total[-1]


def fit_rows(rows: DataFrame, penalty: float = 1.0, steps: int = 25, tolerance: float = 1e-10) -> Fit:
    """Coefficients on a written table of ``feature_rows``, with an L2 ``penalty`` on the
    summed loss (not on the intercept). Stops when no coefficient changes by
    more than ``tolerance``, or after ``steps``. A step is halved while it makes the
    penalised loss worse. An empty table gives zeros for no features."""
    first = rows.select(F.length("x").alias("n")).first()
    k = 1 + (first.n // 8 if first else 0)
    beta, ridge = np.zeros(k), penalty * np.diag([0.0, *np.ones(k - 1)])
    losses, change = [], 0.0
    if first is None:
        return Fit(beta, losses, change)
    products, slope, loss, n = _sums(rows, beta)
    for _ in range(steps):
        losses.append(loss / n)
        cost = loss + beta @ ridge @ beta / 2
        move = np.linalg.lstsq(products + ridge, slope - ridge @ beta, rcond=None)[0]
        for _ in range(30):
            products, slope, loss, n = _sums(rows, beta + move)
            if loss + (beta + move) @ ridge @ (beta + move) / 2 <= cost + 1e-9 * abs(cost):
                break
            move = move / 2
        beta, change = beta + move, float(np.abs(move).max())
        if change <= tolerance:
            break
    return Fit(beta, losses, change)


def reweighted_regression(df: DataFrame, columns: Sequence[str], label: str = TARGET_FLAG, penalty: float = 1.0,
                          steps: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """(term, coefficient, odds_ratio) of ``label`` (0 or 1) on numeric columns, the
    intercept first. Rows in which the label or a column is missing take no part."""

    doubles = [F.col(c).cast("double") for c in columns]
    whole = [F.col(label).isNotNull(), *[d.isNotNull() & ~F.isnan(d) for d in doubles]]
    used = df.select(F.col(label).cast("int").alias("label"), F.array(*doubles).alias("v"), F.array(*whole).alias("w"))
    used = used.where(F.forall("w", lambda x: x)).select("label", array_to_vector("v").alias("features"))
    fit = fit_rows(pin(feature_rows(used, "0L"), "reweighted-rows"), penalty, steps, tolerance)
    terms = ["intercept", *columns]
    values = [*fit.coefficients.tolist(), *[0.0] * (len(terms) - len(fit.coefficients))]
    rows = [(t, float(b), float(np.exp(b))) for t, b in zip(terms, values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, odds_ratio double")
