"""Gradient boosting for two classes: logistic loss, second-order leaf values.

A round fits one tree to the residuals of the rows so far. Each of its levels is one
aggregation over all rows, to sums per node, feature and bin; they are as
many for any number of rows and all that reaches the driver. (A table of at most
``ONE_TASK_ROWS`` rows is summed in one task.) The last level's sums
also give the leaves: the residuals over the second derivatives of their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.ml import forest
from tenura.ml.forest import BINS, bin_edges, coded, feature_rows, matrix
from tenura.sources.shared import pin
from tenura.sources.workers import find_package, map_batches

ONE_TASK_ROWS = 1 << 16  # rows that are boosted in one task
WRITTEN = 25  # rounds after which the rows' scores are written


@dataclass
class BoostedTree:
    """Nodes in heap order (0 the root, 2i+1 and 2i+2 below i): the feature and the
    bin of a split, or -1 and the value that is added to the score."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> BoostedTree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size))

    def reached(self, codes: np.ndarray) -> np.ndarray:
        """The node at which each row stops; a split at a time, a column of codes each."""
        at = np.zeros(len(codes), dtype=np.int16 if len(self.feature) < 1 << 15 else np.int32)
        for node in np.flatnonzero(self.feature >= 0).tolist():
            right = codes[:, self.feature[node]] > self.cut[node]
            at += (at == node) * (right + at.dtype.type(node + 1))
        return at

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.reached(codes)]


@dataclass
class Sums:
    """Residuals, second derivatives and rows per (node, feature, bin)."""

    residual: np.ndarray
    second: np.ndarray
    n: np.ndarray


def best_split(s: Sums, node: int) -> tuple[int, int] | None:
    """The (feature, bin) whose sides' mean residuals are farthest apart, weighted by
    the product of their rows over their sum; None if no feature has two bins."""
    left_r, left_n = (np.cumsum(x[node], axis=1)[:, :-1] for x in (s.residual, s.n))
    right_r = s.residual[node].sum(axis=1)[:, None] - left_r
    right_n = s.n[node].sum(axis=1)[:, None] - left_n
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = (left_r / left_n - right_r / right_n) ** 2 * left_n * right_n / (left_n + right_n)
    gain[(left_n < 1) | (right_n < 1)] = -np.inf
    at = int(gain.argmax())
    return divmod(at, gain.shape[1]) if gain.flat[at] > -np.inf else None


def leaf_value(residual: float, second: float) -> float:
    """One step of Newton's method; no step where all rows are certain already."""
    return residual / second if second > 1e-150 else 0.0


@dataclass
class Boosting:
    base: float
    step: float
    trees: list[BoostedTree] = field(default_factory=list)

    def scores(self, codes: np.ndarray, since: int = 0) -> np.ndarray:
        """What the trees from ``since`` on add."""
        total = np.zeros(len(codes))
        for tree in self.trees[since:]:
            total += self.step * tree.scores(codes)
        return total


def level_sums(codes: np.ndarray, labels: np.ndarray, score: np.ndarray, tree: BoostedTree, level: int
               ) -> tuple[np.ndarray, float]:
    """(residuals, second derivatives, rows) per node of a level, feature and bin, and (at the
    root) the summed log loss, of rows with these scores. ``codes`` are read by column."""
    features, size = codes.shape[1], 2**level * BINS
    p = 1 / (1 + np.exp(-score))
    loss = 0.0 if level else float(np.logaddexp(0, np.where(labels == 1, -score, score)).sum())
    at = tree.reached(codes) - (2**level - 1)
    use = slice(None) if (at >= 0).all() else np.flatnonzero(at >= 0)
    first = at[use].astype(np.int64) * BINS
    residual, second = (labels - p)[use], (p * (1 - p))[use]
    totals = np.empty((3, 2**level, features, BINS))
    for f in range(features):
        key = first + codes[use, f]
        for total, sums in zip(totals, (np.bincount(key, residual, size), np.bincount(key, second, size),
                                        np.bincount(key, minlength=size))):
            total[:, f] = sums.reshape(-1, BINS)
    return totals.reshape(3, -1), loss


def _shaped(totals: np.ndarray, level: int, features: int) -> Sums:
    return Sums(*totals.reshape(3, 2**level, features, BINS))


BLOCKS = "n int, score binary, label binary, x binary"  # many rows: float64, bytes, a byte per feature and row


def _blocks(rows: DataFrame, base: float) -> DataFrame:
    """The rows in blocks, all rows' bins of a feature after the other, with the first scores."""
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                labels = batch.column(0).to_numpy().astype(np.uint8)
                yield _block(n, np.full(n, base), labels.tobytes(), matrix(batch.column(1), "u1").T.tobytes())

    return map_batches(rows.select("label", "x"), task, BLOCKS)


def _block(n: int, score: np.ndarray, labels: bytes, x: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([b], pa.binary()) for b in (
        score.tobytes(), labels, x))], ["n", "score", "label", "x"])


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scores, labels, codes) of each block."""
    for batch in batches:
        for n, score, labels, x in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            codes = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, n).T
            yield np.frombuffer(score.as_buffer(), "<f8"), np.frombuffer(labels.as_buffer(), np.uint8), codes


def _level(blocks: DataFrame, model: Boosting, since: int, tree: BoostedTree, level: int, features: int
           ) -> tuple[Sums, float]:
    """One aggregation over all rows: the sums of a level's nodes, and at the root the log
    loss of the model without this tree (summed)."""
    size = 2**level * features * BINS

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, loss = np.zeros((3, size)), 0.0
        for score, labels, codes in _opened(batches):
            some, lost = level_sums(codes, labels, score + model.scores(codes, since), tree, level)
            totals, loss = totals + some, loss + lost
        cell = np.flatnonzero(totals[2])
        cells = np.append(cell, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells.astype(np.int32)), pa.array(np.append(totals[0][cell], loss)),
             pa.array(np.append(totals[1][cell], 0.0)), pa.array(np.append(totals[2][cell], 0.0))],
            ["cell", "residual", "second", "n"])

    cells = map_batches(blocks, task, "cell int, residual double, second double, n double")
    found = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("residual", "second", "n")]).toArrow()
    cell = found.column("cell").to_numpy()
    kept, lost = np.flatnonzero(cell >= 0), np.flatnonzero(cell < 0)
    totals = np.zeros((3, size))
    for total, name in zip(totals, ("residual", "second", "n")):
        total[cell[kept]] = found.column(name).to_numpy()[kept]
    return _shaped(totals, level, features), float(found.column("residual").to_numpy()[lost].sum())


def _grown(sums_of: Callable[[BoostedTree, int], tuple[Sums, float]], depth: int) -> tuple[BoostedTree, float]:
    """The next tree and the loss before it."""
    tree, before = BoostedTree.empty(depth), 0.0
    for level in range(depth):
        sums, loss = sums_of(tree, level)
        before = before if level else loss
        for node in range(2**level):
            number = 2**level - 1 + node
            if not sums.n[node, 0].sum():
                continue
            split = best_split(sums, node)
            if split is None:
                tree.value[number] = leaf_value(sums.residual[node, 0].sum(), sums.second[node, 0].sum())
                continue
            f, cut = split
            tree.feature[number], tree.cut[number] = f, cut
            for side, bins in enumerate((slice(0, cut + 1), slice(cut + 1, None))):
                tree.value[2 * number + 1 + side] = leaf_value(
                    sums.residual[node, f, bins].sum(), sums.second[node, f, bins].sum())
    return tree, before


def _rounds_in_passes(rows: DataFrame, model: Boosting, rounds: int, depth: int, features: int) -> list[float]:
    """Grow the trees by one pass over all rows per level; the summed losses before them."""
    scored, since, losses = _held(_blocks(rows, model.base)), 0, []
    try:
        for number in range(rounds):
            if number and number % WRITTEN == 0:
                old, scored, since = scored, _held(_with_scores(scored, model, since)), number
                old.unpersist()
            tree, before = _grown(lambda tree, level: _level(scored, model, since, tree, level, features), depth)
            model.trees.append(tree)
            losses.append(before)
    finally:
        scored.unpersist()
    return losses


def _held(blocks: DataFrame) -> DataFrame:
    """Written, and kept while passes read them again."""
    return pin(blocks, "boosting-blocks").persist(StorageLevel.MEMORY_AND_DISK)


def _rounds_in_one_task(rows: DataFrame, model: Boosting, rounds: int, depth: int, features: int) -> list[float]:
    """The same for at most ONE_TASK_ROWS rows, in one task instead of many small jobs."""
    find_package(rows.sparkSession)

    def grow(group: pa.Table) -> pa.Table:
        codes, labels = np.asfortranarray(matrix(group.column("x"), "u1")), group.column("label").to_numpy()
        score, trees, losses = np.full(len(labels), model.base), [], []
        for _ in range(rounds):
            def sums(tree: BoostedTree, level: int) -> tuple[Sums, float]:
                totals, loss = level_sums(codes, labels, score, tree, level)
                return _shaped(totals, level, features), loss

            tree, before = _grown(sums, depth)
            score = score + model.step * tree.scores(codes)
            trees.append(tree)
            losses.append(before)
        return pa.table({
            "number": pa.array(range(rounds), pa.int32()), "loss": pa.array(losses, pa.float64()),
            "feature": pa.array([t.feature.tolist() for t in trees], pa.list_(pa.int32())),
            "cut": pa.array([t.cut.tolist() for t in trees], pa.list_(pa.int32())),
            "value": pa.array([t.value.tolist() for t in trees], pa.list_(pa.float64()))})

    grown = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(
        grow, "number int, loss double, feature array<int>, cut array<int>, value array<double>").collect()
    found = sorted(grown, key=lambda r: r.number)     # one per round
    model.trees += [BoostedTree(np.array(r.feature), np.array(r.cut), np.array(r.value)) for r in found]
    return [r.loss for r in found]


class NewtonBoosting(Estimator):
    """``rounds`` trees of ``depth`` levels, each added with weight ``step``; rows
    without features or label aren't allowed. Splits are searched over at most BINS
    bins per feature."""

    def __init__(self, rounds: int = 100, depth: int = 3, step: float = 0.1):
        super().__init__()
        self.rounds, self.depth, self.step = rounds, depth, step

    def _fit(self, df: DataFrame) -> BoostingModel:
        edges = bin_edges(df)
        rows = pin(coded(feature_rows(df, "0L"), edges), "boosting-rows")
        n, positive = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
        share = min(max(positive / n, 1e-12), 1 - 1e-12)
        model = Boosting(float(np.log(share / (1 - share))), self.step)
        grow = _rounds_in_one_task if n <= min(ONE_TASK_ROWS, forest.LOCAL_ROWS) else _rounds_in_passes
        losses = grow(rows, model, self.rounds, self.depth, len(edges))
        return BoostingModel(model, edges, [loss / n for loss in losses])


def _with_scores(blocks: DataFrame, model: Boosting, since: int) -> DataFrame:
    """The blocks with what the trees from ``since`` on add."""
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for score, labels, codes in _opened(batches):
            yield _block(len(score), score + model.scores(codes, since), labels.tobytes(), codes.T.tobytes())

    return map_batches(blocks, task, BLOCKS)


class BoostingModel(Model):
    """Adds ``probability`` and ``prediction``. ``losses`` are the mean log losses on the
    training rows before each round."""

    def __init__(self, model: Boosting, edges: list[np.ndarray], losses: list[float]):
        super().__init__()
        self.model, self.edges, self.losses = model, edges, losses

    def _transform(self, df: DataFrame) -> DataFrame:
        find_package(df.sparkSession)
        model, edges = self.model, self.edges

        @F.pandas_udf("double")
        def share(features: pd.Series) -> pd.Series:
            x = np.stack(features.to_numpy())
            codes = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)]).T
            return pd.Series(1 / (1 + np.exp(-(model.base + model.scores(codes)))))

        judged = df.withColumn("_share", share(vector_to_array("features")))
        return judged.withColumns({
            "probability": array_to_vector(F.array(1 - F.col("_share"), F.col("_share"))),
            "prediction": (F.col("_share") > 0.5).cast("double"),
        }).drop("_share")
