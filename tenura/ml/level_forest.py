"""A random forest on many rows: all trees take each level in one pass.

The rules are those of Spark's classifier: every tree sees a Poisson sample of the rows,
a node tries a random subset of the features at the edges of BINS bins and splits
at the best one if that lowers Gini impurity, and leaves below one node that
predict the same class are one leaf. Spark's passes walk through every tree and
update sums at random places for each row; here a task goes through its rows a tree at a time,
a column of bins at a time.

Rows are kept in blocks of bins. A pass gives sums per (node, feature tried, bin), which
are added per tree and stretch of nodes. The trees, all that reaches the driver, are as many
numbers for any number of rows. Choices are hashes of a row's number or a node's path, and sums
are whole numbers, so a forest does not depend on how the rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.ml.forest import BINS, POISSON, best_cuts, bin_edges, child, feature_order, mixed, root_of
from tenura.schema import RANDOM_SEED
from tenura.sources.shared import pin
from tenura.sources.workers import find_package, map_batches

BLOCK_ROWS = 1 << 15  # rows of a block
TASK_BLOCKS = 4  # blocks in a task where there are many
STRETCH = 64  # nodes of a tree whose sums are added in one group
HEAP_NODES = 1 << 20  # places for nodes of the trees that grow together
MOST_DEPTH = 16
SHIFT = 1 << 26  # sums of class 1 in a double, above those of both classes
BLOCKS = "n int, hash binary, label binary, x binary"
SUMS = "tree int, stretch int, cell binary, w binary, w1 binary"
SPLITS = "tree int, node int, feature int, cut int, w0 double, w1 double, l0 double, l1 double"


@dataclass
class Trees:
    """Trees in heap order (0 the root, 2i+1 and 2i+2 below i), one per row: the feature and the
    bin of a split, or -1, and the class weights of every node."""

    feature: np.ndarray
    cut: np.ndarray
    w0: np.ndarray
    w1: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int) -> Trees:
        shape = trees, 2 ** (depth + 1) - 1
        return cls(np.full(shape, -1, np.int32), np.zeros(shape, np.uint8), np.zeros(shape), np.zeros(shape))

    def merge_leaves(self) -> None:
        """Make one leaf of two leaves that predict the same class, from below."""
        says = self.w1 > self.w0
        inner = np.arange(self.feature.shape[1] // 2)
        for node in inner[::-1].tolist():
            a, b = 2 * node + 1, 2 * node + 2
            same = (self.feature[:, a] < 0) & (self.feature[:, b] < 0) & (says[:, a] == says[:, b])
            self.feature[same, node] = -1

    def shares(self) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return self.w1 / (self.w0 + self.w1)


# --- blocks of rows --------------------------------------------------------------------

def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of the rows' features, a feature after the other."""
    return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)]).astype(np.uint8)


def _blocks(df: DataFrame, edges: list[np.ndarray], tasks: int) -> DataFrame:
    """The rows in blocks, written, and kept while passes read them again."""

    def block(numbers: list, labels: list, codes: list) -> pa.RecordBatch:
        number, label = np.concatenate(numbers), np.concatenate(labels)
        if not np.isin(label, (0.0, 1.0)).all():
            raise ValueError("labels must be 0 or 1")
        cells = mixed(number.view(np.uint64)), label.astype(np.uint8), np.concatenate(codes, axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array([len(label)], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)],
            ["n", "hash", "label", "x"])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], []), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(edges))
                for column, values in zip(held, (part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False),
                                                 _codes(x, edges))):
                    column.append(values)
                size += part.num_rows
                if size >= BLOCK_ROWS:
                    yield block(*held)
                    held, size = ([], [], []), 0
        if size:
            yield block(*held)

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col("label").cast("double").alias("label"),
                     vector_to_array("features").alias("v"))
    blocks = pin(map_batches(rows, task, BLOCKS), "forest-blocks")
    return blocks.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)


def sample(hashes: np.ndarray, root: np.uint64) -> np.ndarray:
    """How often each row is in a tree's sample (``forest.bootstrap`` of mixed numbers)."""
    return np.searchsorted(POISSON, (mixed(hashes ^ root) >> np.uint64(11)) * 2.0**-53, side="right")


def level_sums(hashes: np.ndarray, labels: np.ndarray, codes: np.ndarray, root: np.uint64, feature: np.ndarray,
               cut: np.ndarray, level: int, tried: np.ndarray, is_open: np.ndarray) -> np.ndarray:
    """Sums per (feature place, node, bin) of a level over a block's rows: weights, and SHIFT
    times those of class 1. ``codes`` are flat, ``tried`` is (places, nodes)."""
    n = len(labels)
    weights = sample(hashes, root)
    rows = np.flatnonzero(weights)
    at = np.zeros(len(rows), dtype=np.int64)
    for above in range(level):
        first = 2**above - 1
        here = feature[first:2 * first + 1].astype(np.int64)
        f = here[at]
        if (here < 0).any():
            on = np.flatnonzero(f >= 0)
            rows, at, f = rows[on], at[on], f[on]
        at = 2 * at + (codes[f * n + rows] > cut[first:2 * first + 1][at])
    if not is_open.all():
        on = np.flatnonzero(is_open[at])
        rows, at = rows[on], at[on]
    both = weights[rows] * (1.0 + labels[rows] * float(SHIFT))
    first, size = at * BINS, len(is_open) * BINS
    return np.stack([np.bincount(first + codes[(f.astype(np.int64) * n)[at] + rows], both, size) for f in tried])


def _pass(blocks: DataFrame, roots: np.ndarray, trees: Trees, level: int, tried: np.ndarray, is_open: np.ndarray
          ) -> DataFrame:
    """The best split (if any) of every open node of a level, by one aggregation over all rows.
    ``tried`` is (trees, places, nodes)."""
    inner = 2**level - 1
    feature, cut = trees.feature[:, :inner], trees.cut[:, :inner]
    growing = np.flatnonzero(is_open.any(axis=1)).tolist()
    places, nodes = tried.shape[1:]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(np.frombuffer(c.as_buffer(), kind) for c, kind in zip(row, (np.uint64, np.uint8, np.uint8)))
                for batch in batches for row in zip(*batch.columns[1:])]
        for tree in growing if held else ():
            total = np.zeros((places, nodes * BINS))
            for hashes, labels, codes in held:
                total += level_sums(hashes, labels, codes, roots[tree], feature[tree], cut[tree], level,
                                    tried[tree], is_open[tree])
            sums = total.astype(np.int64).reshape(places, nodes, BINS).transpose(1, 0, 2)
            pieces = []
            for start in range(0, nodes, STRETCH):
                some = sums[start:start + STRETCH].ravel()
                cell = np.flatnonzero(some)
                if len(cell):
                    w1, w = np.divmod(some[cell], SHIFT)
                    pieces.append((tree, start // STRETCH, *(v.astype(np.int32).tobytes() for v in (cell, w, w1))))
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*pieces), (pa.int32(), pa.int32(), *[pa.binary()] * 3))], ["tree", "stretch", "cell", "w", "w1"])

    def choose(group: pa.Table) -> pa.Table:
        tree, start = group.column("tree")[0].as_py(), group.column("stretch")[0].as_py() * STRETCH
        here = min(STRETCH, nodes - start)
        cell, w, w1 = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int32) for c in ("cell", "w", "w1"))
        shape = here, places, BINS
        w, w1 = (np.bincount(cell, v, here * places * BINS).reshape(shape) for v in (w, w1))
        all_w, all_1 = (v[:, 0].sum(axis=1) for v in (w, w1))
        place, at, found, l0, l1, _ = best_cuts(w - w1, w1, w, 1)
        some = np.flatnonzero(all_w)
        place, at, found, l0, l1, w, w1 = (v[some] for v in (place, at, found, l0, l1, all_w, all_1))
        w0 = w - w1
        r0, r1 = w0 - l0, w1 - l1
        with np.errstate(invalid="ignore", divide="ignore"):
            better = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1) - (w0 * w0 + w1 * w1) / w
        chosen = np.where(found & (better > 1e-12 * w), tried[tree, place, start + some], -1)
        ints = np.full(len(some), tree), start + some, chosen, at
        return pa.table([*(pa.array(v.astype(np.int32)) for v in ints), *(pa.array(v) for v in (w0, w1, l0, l1))],
                        names=["tree", "node", "feature", "cut", "w0", "w1", "l0", "l1"])

    return map_batches(blocks, task, SUMS).groupBy("tree", "stretch").applyInArrow(choose, SPLITS)


def _grown(blocks: DataFrame, roots: np.ndarray, depth: int, features: int, places: int) -> Trees:
    trees = Trees.empty(len(roots), depth)
    paths, is_open = roots[:, None], np.ones((len(roots), 1), dtype=bool)
    for level in range(depth):
        tried = np.zeros((*paths.shape, places), dtype=np.int32)
        tried[is_open] = feature_order(paths[is_open], features)[:, :places]
        found = _pass(blocks, roots, trees, level, tried.transpose(0, 2, 1), is_open).toArrow()
        tree, at, feature, cut, w0, w1, l0, l1 = (c.to_numpy() for c in found.columns)
        node = 2**level - 1 + at
        trees.feature[tree, node], trees.cut[tree, node] = feature, np.where(feature >= 0, cut, 0)
        trees.w0[tree, node], trees.w1[tree, node] = w0, w1
        split = feature >= 0
        tree, at, node, w0, w1, l0, l1 = (v[split] for v in (tree, at, node, w0, w1, l0, l1))
        paths = np.stack([child(paths, 0), child(paths, 1)], axis=2).reshape(len(roots), -1)
        is_open = np.zeros(paths.shape, dtype=bool)
        for side, (a, b) in enumerate(((l0, l1), (w0 - l0, w1 - l1))):
            trees.w0[tree, 2 * node + 1 + side], trees.w1[tree, 2 * node + 1 + side] = a, b
            is_open[tree, 2 * at + side] = (a > 0) & (b > 0)
        if not is_open.any():
            break
    trees.merge_leaves()
    return trees


class LevelForest(Estimator):
    """``trees`` trees of at most ``depth`` levels for two classes; rows without features or
    label aren't allowed. A node tries the square root of the features, rounded up."""

    def __init__(self, trees: int = 300, depth: int = 10, seed: int = RANDOM_SEED):
        super().__init__()
        if not 1 <= depth <= MOST_DEPTH:
            raise ValueError(f"depth must be from 1 to {MOST_DEPTH}")
        self.trees, self.depth, self.seed = trees, depth, seed

    def _fit(self, df: DataFrame) -> LevelForestModel:
        edges = bin_edges(df)
        cores = df.sparkSession.sparkContext.defaultParallelism
        n = -(-df.count() // BLOCK_ROWS)
        blocks = _blocks(df, edges, max(1, min(n, 2 * cores), -(-n // TASK_BLOCKS)))
        lot = max(1, HEAP_NODES >> self.depth)
        try:
            grown = [_grown(blocks, np.array([root_of(t, self.seed) for t in range(first, min(self.trees, first + lot))]),
                            self.depth, len(edges), int(np.ceil(len(edges)**0.5))) for first in range(0, self.trees, lot)]
        finally:
            blocks.unpersist()
        return LevelForestModel(grown, edges)


class LevelForestModel(Model):
    """Adds ``probability`` (the trees' mean shares of the classes) and ``prediction``."""

    def __init__(self, grown: list[Trees], edges: list[np.ndarray]):
        super().__init__()
        self.grown, self.edges = grown, edges

    def _transform(self, df: DataFrame) -> DataFrame:
        find_package(df.sparkSession)
        grown, edges = [(t.feature, t.cut, t.shares()) for t in self.grown], self.edges

        @F.pandas_udf("double")
        def share(features: pd.Series) -> pd.Series:
            codes, n = _codes(np.stack(features.to_numpy()), edges).ravel(), len(features)
            total, trees = np.zeros(n), 0
            for lot in grown:
                for feature, cut, value in zip(*lot):
                    at, rows = np.zeros(n, dtype=np.int64), np.arange(n)
                    while len(rows):
                        here = at[rows]
                        f = feature[here].astype(np.int64)
                        on = np.flatnonzero(f >= 0)
                        rows, here, f = rows[on], here[on], f[on]
                        at[rows] = 2 * here + 1 + (codes[f * n + rows] > cut[here])
                    total += value[at]
                trees += len(lot[0])
            return pd.Series(total / trees)

        judged = df.withColumn("_share", share(vector_to_array("features")))
        return judged.withColumns({
            "probability": array_to_vector(F.array(1 - F.col("_share"), F.col("_share"))),
            "prediction": (F.col("_share") > 0.5).cast("double"),
        }).drop("_share")
