"""Forests as tables of nodes: grown level by level, pruned and scored as tables.

A tree's nodes are named by their path from the root (a 64-bit hash), and every
random choice is a hash of that name: a tree is the same wherever and in
whatever order its nodes are grown, and cutting a deep tree gives the tree that a
fit with stricter limits gives.

Nodes with many rows are split by one aggregation per level over all rows; what
lies below a node with at most ``LOCAL_ROWS`` rows is grown in one task, which
holds only that node's rows. Both use the same code on sums of class weights.

Grown nodes are written as pieces, one record for all that a task grew of a tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.schema import RANDOM_SEED
from tenura.sources.shared import pin, shuffles_dropped
from tenura.sources.workers import map_batches

LOCAL_ROWS = 1 << 20  # rows of a node that are grown in one task
CHUNK_ROWS = 1 << 16  # of them whose splits are searched at a time
BATCH_ROWS = 1 << 16  # rows that a pass or the dealing takes through the trees at a time
PIECES_BYTES = 1 << 24  # of dealt rows handed on at a time
DEALT_BYTES = 1 << 33  # of rows dealt to trees in one job
TOP_NODES = 1 << 17  # nodes above those that tasks are told, for a batch of trees
BINS, FEW_BINS = 32, 8  # of a feature, where splits are searched over bins
TREE_LOT, ROW_BLOCK = 25, 1 << 19  # trees and rows scored together
LOT_NODES = 1 << 21  # nodes of the trees scored together
ROOT = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
NODES = ("variant int, tree int, node bigint, depth int, feature int, threshold double, "
         "n bigint, w0 double, w1 double")
PIECES = "variant int, tree int, node bigint, depth int, top boolean, size int, data binary"


# --- choices by hash ---------------------------------------------------------------

def mixed(values: np.ndarray) -> np.ndarray:
    """Hash of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.asarray(values, dtype=np.uint64) + ROOT
        x = (x ^ (x >> np.uint64(30))) * FACTORS[0]
        x = (x ^ (x >> np.uint64(27))) * FACTORS[1]
    return x ^ (x >> np.uint64(31))


def root_of(tree: int, seed: int) -> np.uint64:
    return mixed(mixed(np.uint64(seed)) ^ np.uint64(tree))


def child(paths: np.ndarray, side: int) -> np.ndarray:
    return mixed(mixed(paths) ^ np.uint64(side + 1))


def drawn(paths: np.ndarray, numbers: np.ndarray, purpose: int) -> np.ndarray:
    """Uniform numbers from 0 to 1 (excluded), one per path and number."""
    base = mixed(np.asarray(paths, dtype=np.uint64) ^ np.uint64(purpose << 32))
    x = mixed(base[..., None] ^ np.asarray(numbers, dtype=np.uint64))
    return (x >> np.uint64(11)) * 2.0**-53


def feature_order(paths: np.ndarray, features: int) -> np.ndarray:
    """The order in which each node tries the features: by draws of 53 bits, then number."""
    if features > 1 << 11:
        return np.argsort(drawn(paths, np.arange(features), 1), axis=1, kind="stable")
    number = np.arange(features, dtype=np.uint64)
    base = mixed(np.asarray(paths, dtype=np.uint64) ^ np.uint64(1 << 32))
    keys = mixed(base[..., None] ^ number) >> np.uint64(11) << np.uint64(11) | number
    keys.sort(axis=1)
    return (keys & np.uint64((1 << 11) - 1)).astype(np.int64)


def bootstrap(rows: np.ndarray, root: np.uint64) -> np.ndarray:
    """How often each row is in a tree's sample: Poisson of mean 1, from a hash of
    its number, which is what drawing with replacement tends to."""
    u = (mixed(mixed(rows.view(np.uint64)) ^ root) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(POISSON, u, side="right")


POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


# --- splits ------------------------------------------------------------------------

@dataclass(frozen=True)
class Growth:
    """How a forest grows. ``random_cuts``: a threshold per node and feature drawn
    from the node's range; else the best edge of bins. ``variants`` share rows and
    samples: (least rows of a leaf, weight of class 0, weight of class 1)."""

    trees: int
    tried: int  # features tried at a node
    random_cuts: bool
    sampled: bool
    depth: int | None = None
    variants: tuple[tuple[int, float, float], ...] = ((1, 1.0, 1.0),)
    seed: int = RANDOM_SEED


def best_cuts(w0: np.ndarray, w1: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Per node the best (feature place, bin) by Gini impurity from sums of shape
    (nodes, features, bins), whether there is one, and the left side's sums. Equal
    splits go to the feature tried first and the lowest bin."""
    left = [np.cumsum(x, axis=2)[:, :, :-1] for x in (w0, w1, n)]
    right = [x.sum(axis=2)[:, :, None] - l for x, l in zip((w0, w1, n), left)]
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = sum((a * a + b * b) / (a + b) for a, b, _ in (left, right))
    gain[(left[2] < least) | (right[2] < least)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    nodes = np.arange(len(gain))
    place, cut = np.divmod(at, gain.shape[2])
    return place, cut, flat[nodes, at] > -np.inf, *(x[nodes, place, cut] for x in left)


def random_thresholds(paths: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A threshold in [low, high) of each node and feature."""
    base = mixed(np.asarray(paths, dtype=np.uint64) ^ np.uint64(2 << 32))
    u = (mixed(base[:, None] ^ features.astype(np.uint64)) >> np.uint64(11)) * 2.0**-53
    cut = low + u * (high - low)
    return np.where(cut < high, cut, low)


@dataclass(frozen=True)
class Layout:
    """How rows travel to their trees: features of at most two values as bits, the others as
    they are. Of bins, ``low`` and ``high`` are 0 and 1."""

    two: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kind: str

    def packed(self, values: np.ndarray) -> np.ndarray:
        bits = np.packbits(values[:, self.two] == self.high[self.two], axis=1, bitorder="little")
        rest = np.ascontiguousarray(values[:, ~self.two], dtype=self.kind).view(np.uint8).reshape(len(values), -1)
        return np.concatenate([bits, rest], axis=1)

    @property
    def slots(self) -> np.ndarray:
        """Each feature's place among the bits or among the other columns."""
        return np.where(self.two, np.cumsum(self.two), np.cumsum(~self.two)) - 1

    @property
    def width(self) -> int:
        """Bytes of a row."""
        return -(-int(self.two.sum()) // 8) + int((~self.two).sum()) * np.dtype(self.kind).itemsize

    def columns(self, data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits of the rows as words of 64, and the other columns, each after the other."""
        rows = np.frombuffer(data, dtype=np.uint8).reshape(n, -1)
        bits = -(-int(self.two.sum()) // 8)
        words = np.zeros((n, max(1, -(-bits // 8)) * 8), dtype=np.uint8)
        words[:, :bits] = rows[:, :bits]
        wide = np.ascontiguousarray(rows[:, bits:]).view(self.kind) if rows.shape[1] > bits else np.empty((n, 0), self.kind)
        return np.ascontiguousarray(words.view("<u8").T), np.ascontiguousarray(wide.T)


class Tally:
    """What is summed over rows: number, weight and weight of class 1, in one or two whole
    numbers per row, so that sums over stretches of rows are exact and take one pass."""

    def __init__(self, labels: np.ndarray, weights: np.ndarray, sampled: bool):
        w = weights.astype(np.int64)
        w1 = w * labels
        self.kind = "weights" if not sampled else "one" if max(len(w), int(w.sum())) < 1 << 21 else "two"
        self.parts = {"weights": lambda: [w + (w1 << 32)], "one": lambda: [1 + (w << 21) + (w1 << 42)],
                      "two": lambda: [w + (w1 << 32), np.ones_like(w)]}[self.kind]()

    def read(self, sums: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, weight of class 0, weight of class 1)."""
        if self.kind == "one":
            low = (1 << 21) - 1
            n, w, w1 = sums[0] & low, sums[0] >> 21 & low, sums[0] >> 42
        else:
            w, w1 = sums[0] & ((1 << 32) - 1), sums[0] >> 32
            n = w if self.kind == "weights" else sums[1]
        return n, w - w1, w1


@dataclass
class Held:
    """The rows of some nodes, a node's after the other's: places of the rows in their table,
    bits, and parts of the tally."""

    counts: np.ndarray
    rows: np.ndarray
    words: np.ndarray
    parts: list[np.ndarray]

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    def sums(self, masks: np.ndarray | None = None) -> list[np.ndarray]:
        """Per node the sums of the tally, over the rows where ``masks`` is 1."""
        starts = self.starts
        return [np.add.reduceat(p if masks is None else p * masks, starts) for p in self.parts]

    def some(self, use: np.ndarray) -> Held:
        """Only these nodes."""
        if use.all():
            return self
        return self.of_rows(np.flatnonzero(np.repeat(use, self.counts)), self.counts[use])

    def of_rows(self, some: np.ndarray, counts: np.ndarray) -> Held:
        return Held(counts, self.rows[some], self.words[:, some], [p[some] for p in self.parts])

    def nodes(self, first: int, last: int, start: int, end: int) -> Held:
        return Held(self.counts[first:last], self.rows[start:end], self.words[:, start:end], [p[start:end] for p in self.parts])

    def bits(self, slot: np.ndarray) -> np.ndarray:
        """Per row the bit of its node's column among those kept as bits."""
        shift = np.repeat((slot & 63).astype(np.uint64), self.counts)
        words = self.words[0]
        if len(self.words) > 1:
            words = self.words[np.repeat(slot >> 6, self.counts), np.arange(len(self.rows))]
        np.right_shift(words, shift, out=shift)
        np.bitwise_and(shift, np.uint64(1), out=shift)
        return shift.view(np.int64)

    def again(self, nodes: np.ndarray) -> Held:
        """These nodes, which may come more than once, without bits."""
        counts = self.counts[nodes]
        ends = np.cumsum(counts)
        at = np.repeat(self.starts[nodes] - ends + counts, counts) + np.arange(ends[-1])
        return Held(counts, self.rows[at], self.words[:, :0], [p[at] for p in self.parts])

    def wide(self, table: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Per row the value of its node's column of ``table``."""
        return np.take(table.ravel(), np.repeat(slot * table.shape[1], self.counts) + self.rows)


def gini(l0: np.ndarray, l1: np.ndarray, r0: np.ndarray, r1: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)


def _two_sides(left: tuple, right: tuple, variant: tuple) -> np.ndarray:
    """The gain of splits in two, from (rows, weights of the classes) of both sides."""
    l0, l1 = left[1] * variant[1], left[2] * variant[2]
    r0, r1 = (l0 + right[1] * variant[1]) - l0, (l1 + right[2] * variant[2]) - l1
    gain = gini(l0, l1, r0, r1)
    gain[(left[0] < variant[0]) | (right[0] < variant[0])] = -np.inf
    return gain


def _bin_cuts(held: Held, tally: Tally, codes: np.ndarray, variant: tuple, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The best gain and bin of each node from its rows' bins."""
    k = len(held.counts)
    key = np.repeat(np.arange(k) * bins, held.counts) + codes
    n, w0, w1 = (np.bincount(key, x, k * bins).reshape(k, 1, bins) for x in tally.read(held.parts))
    w0, w1 = w0 * variant[1], w1 * variant[2]
    left = [np.cumsum(x, axis=2)[:, 0, :-1] for x in (w0, w1, n)]
    right = [x.sum(axis=2) - l for x, l in zip((w0, w1, n), left)]
    gain = gini(left[0], left[1], right[0], right[1])
    gain[(left[2] < variant[0]) | (right[2] < variant[0])] = -np.inf
    cut = gain.argmax(axis=1)
    return gain[np.arange(k), cut], cut


def _wide_cuts(growth: Growth, variant: tuple, paths: np.ndarray, f: np.ndarray, slot: np.ndarray, held: Held,
               tally: Tally, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gain and limit of each node's best split (with random cuts: its only one) in its column."""
    values = held.wide(table, slot)
    if not growth.random_cuts:
        few = np.maximum.reduceat(values, held.starts) < FEW_BINS
        gain, cut = np.empty(len(f)), np.empty(len(f))
        for use, bins in ((few, FEW_BINS), (~few, BINS)):
            if use.any():
                rows = np.repeat(use, held.counts)
                there = Held(held.counts[use], held.rows[:0], held.words, [p[rows] for p in held.parts])
                gain[use], cut[use] = _bin_cuts(there, tally, values[rows], variant, bins)
        return gain, cut
    low, high = np.minimum.reduceat(values, held.starts), np.maximum.reduceat(values, held.starts)
    limits = random_thresholds(paths, f[:, None], low[:, None], high[:, None])[:, 0]
    whole = tally.read(held.sums())
    right = tally.read(held.sums((values > np.repeat(limits, held.counts)).astype(np.int64)))
    return _two_sides(tuple(a - b for a, b in zip(whole, right)), right, variant), limits


def _first_splits(growth: Growth, variant: tuple, layout: Layout, slots: np.ndarray, paths: np.ndarray, held: Held,
                  tally: Tally, table: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node the feature (-1: none) and the limit of the best split in the features ``tried``
    (nodes, places); equal splits go to the one tried first and the lowest bin."""
    gain, cut = np.full(tried.shape, -np.inf), np.zeros(tried.shape)
    two = layout.two[tried]
    whole = tally.read(held.sums())
    for place in range(tried.shape[1]):
        if two[:, place].any():
            right = tally.read(held.sums(held.bits(np.where(two[:, place], slots[tried[:, place]], 0))))
            gain[:, place] = _two_sides(tuple(a - b for a, b in zip(whole, right)), right, variant)
    gain[~two] = -np.inf
    if growth.random_cuts:
        cut = random_thresholds(paths, tried, layout.low[tried], layout.high[tried])
    node, place = np.nonzero(~two)
    if len(node):
        f = tried[node, place]
        gain[node, place], cut[node, place] = _wide_cuts(growth, variant, paths[node], f, slots[f], held.again(node), tally, table)
    best, nodes = gain.argmax(axis=1), np.arange(len(paths))
    return np.where(gain[nodes, best] > -np.inf, tried[nodes, best], -1), cut[nodes, best]


def best_splits(growth: Growth, variant: tuple, layout: Layout, slots: np.ndarray, paths: np.ndarray, held: Held,
                tally: Tally, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node the feature (-1: none) and the limit of its best split; limits are numbers of
    bins or, with random cuts, thresholds. Features are tried some at a time until one splits."""
    feature, limit = np.full(len(paths), -1), np.full(len(paths), np.nan)
    open_nodes = np.arange(len(paths))
    for begin in range(0, len(slots), growth.tried):
        ends, first = np.cumsum(held.counts), 0
        while first < len(open_nodes):
            start = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, start + CHUNK_ROWS, side="right")))
            nodes = open_nodes[first:last]
            tried = feature_order(paths[nodes], len(slots))[:, begin:begin + growth.tried]
            feature[nodes], limit[nodes] = _first_splits(growth, variant, layout, slots, paths[nodes], held.nodes(
                first, last, start, int(ends[last - 1])), tally, table, tried)
            first = last
        none = feature[open_nodes] < 0
        if not none.any():
            break
        open_nodes, held = open_nodes[none], held.some(none)
        if not begin:  # rows that are all alike split nowhere
            vary = _vary(held, table)
            open_nodes, held = open_nodes[vary], held.some(vary)
        if not len(open_nodes):
            break
    return feature, limit


def _vary(held: Held, table: np.ndarray) -> np.ndarray:
    """Whether the rows of each node differ in any feature."""
    starts, vary = held.starts, np.zeros(len(held.counts), dtype=bool)
    for words in held.words:
        vary |= np.bitwise_or.reduceat(words ^ np.repeat(words[starts], held.counts), starts) != 0
    for column in table:
        values = column[held.rows]
        vary |= np.minimum.reduceat(values, starts) != np.maximum.reduceat(values, starts)
    return vary


def grow_below(growth: Growth, variant: tuple, path: np.uint64, depth: int, layout: Layout, words: np.ndarray,
               table: np.ndarray, labels: np.ndarray, weights: np.ndarray, edges: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The nodes from ``path`` down, level by level, from the rows that reach it (``Layout.columns``).
    In a level the left sides of the splits above come first, then their right sides."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in ("feature", "threshold", "n", "w0", "w1")}
    tally = Tally(labels, weights, growth.sampled)
    held = Held(np.array([len(labels)]), np.arange(len(labels)), words, tally.parts)
    slots = layout.slots
    paths = np.array([path], dtype=np.uint64)
    while len(paths):
        n, w0, w1 = tally.read(held.sums())
        w0, w1 = w0 * variant[1], w1 * variant[2]
        feature, threshold = np.full(len(paths), -1), np.full(len(paths), np.nan)
        is_open = (w0 > 0) & (w1 > 0) & (n >= 2 * variant[0])
        if growth.depth is not None and depth >= growth.depth:
            is_open[:] = False
        open_nodes = np.flatnonzero(is_open)
        if len(open_nodes):
            held, paths = held.some(is_open), paths[is_open]
            chosen, limit = best_splits(growth, variant, layout, slots, paths, held, tally, table)
            split = chosen >= 0
            held, paths, chosen, limit = held.some(split), paths[split], chosen[split], limit[split]
            feature[open_nodes[split]] = chosen
            threshold[open_nodes[split]] = limit if growth.random_cuts else [
                edges[f][c] for f, c in zip(chosen.tolist(), limit.astype(np.int64).tolist())]
        else:
            paths = paths[:0]
        for name, column in zip(parts, (feature, threshold, n, w0, w1)):
            parts[name].append(column)
        if len(paths):
            held = _parted(held, layout.two[chosen], slots[chosen], limit, table)
            paths = np.concatenate([child(paths, 0), child(paths, 1)])
        depth += 1
    return {c: np.concatenate(v) for c, v in parts.items()}


def _parted(held: Held, two: np.ndarray, slot: np.ndarray, limit: np.ndarray, table: np.ndarray) -> Held:
    """The rows at the nodes below: left sides first, then right sides."""
    right = held.bits(np.where(two, slot, 0)).astype(bool)
    if not two.all():
        there = held.some(~two)
        right[np.repeat(~two, held.counts)] = there.wide(table, slot[~two]) > np.repeat(limit[~two], there.counts)
    counts = np.add.reduceat(right, held.starts, dtype=np.int64)
    return held.of_rows(np.concatenate([np.flatnonzero(~right), np.flatnonzero(right)]),
                        np.concatenate([held.counts - counts, counts]))


# --- grown nodes as pieces --------------------------------------------------------------

def piece_bytes(found: dict[str, np.ndarray], top: bool = False) -> bytes:
    """A piece's nodes column by column; names and depths only for the nodes above, as
    those below follow from the splits."""
    kinds = {"node": "<u8", "depth": "<i4"} if top else {}
    kinds |= {"feature": "<i4", "n": "<i8" if top else "<i4", "threshold": "<f8", "w0": "<f8", "w1": "<f8"}
    return b"".join(np.asarray(found[c]).astype(kind).tobytes() for c, kind in kinds.items())


def piece_nodes(node: int, depth: int, top: bool, size: int, data: bytes) -> dict[str, np.ndarray]:
    """The nodes of a piece, named and with the place of their left and right node below
    in the piece (-1: none there)."""
    kinds = {"node": "<u8", "depth": "<i4"} if top else {}
    kinds |= {"feature": "<i4", "n": "<i8" if top else "<i4", "threshold": "<f8", "w0": "<f8", "w1": "<f8"}
    found, at = {}, 0
    for c, kind in kinds.items():
        found[c] = np.frombuffer(data, kind, size, at)
        at += found[c].nbytes
    found["below"] = np.full((size, 2), -1)
    if top:
        place = {path: i for i, path in enumerate(found["node"].tolist())}
        for i in np.flatnonzero(found["feature"] >= 0).tolist():
            found["below"][i] = [place.get(int(child(found["node"][i], side)), -1) for side in (0, 1)]
        return found
    found["node"], found["depth"] = np.empty(size, np.uint64), np.empty(size, np.int32)
    first, paths = 0, np.array([node & (2**64 - 1)], dtype=np.uint64)
    while len(paths):
        last = first + len(paths)
        found["node"][first:last], found["depth"][first:last] = paths, depth
        split = np.flatnonzero(found["feature"][first:last] >= 0)
        found["below"][first + split, 0] = last + np.arange(len(split))
        found["below"][first + split, 1] = last + len(split) + np.arange(len(split))
        paths = np.concatenate([child(paths[split], 0), child(paths[split], 1)])
        first, depth = last, depth + 1
    return found


def nodes_of(pieces: DataFrame) -> DataFrame:
    """The table of nodes (``NODES``) of a table of pieces."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = piece_nodes(*(r[c] for c in ("node", "depth", "top", "size", "data")))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(r["size"], r["variant"], np.int32)), pa.array(np.full(r["size"], r["tree"], np.int32)),
                    pa.array(found["node"].view(np.int64)), *(pa.array(found[c].astype(kind)) for c, kind in (
                        ("depth", np.int32), ("feature", np.int32), ("threshold", np.float64), ("n", np.int64),
                        ("w0", np.float64), ("w1", np.float64)))],
                    ["variant", "tree", "node", "depth", "feature", "threshold", "n", "w0", "w1"])

    return map_batches(pieces, task, NODES)


# --- rows and features ---------------------------------------------------------------

def feature_rows(df: DataFrame, row: str, label: str = "label", features: str = "features") -> DataFrame:
    """(row, label, x): a number of each row, its class and its features as bytes of
    float64. Missing features and labels aren't allowed."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            x = np.ascontiguousarray(flat, dtype="<f8").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["row", "label", "x"])

    rows = df.select(F.expr(row).alias("row"), F.col(label).cast("int").alias("label"),
                     vector_to_array(features).alias("v"))
    return map_batches(rows, task, "row bigint, label int, x binary")


def matrix(column: pa.Array | pa.ChunkedArray, kind: str = "<f8") -> np.ndarray:
    items = column.to_pylist()
    return np.frombuffer(b"".join(items), dtype=kind).reshape(len(items), -1)


def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together, BATCH_ROWS rows and more at a time."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= BATCH_ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def bin_edges(df: DataFrame, features: str = "features", bins: int = BINS) -> list[np.ndarray]:
    """Per feature at most ``bins`` - 1 rising edges, quantiles of its values; a value is
    in the first bin whose edge it does not exceed. A few numbers per feature."""
    size = df.select(F.size(vector_to_array(features))).first()
    arrays = df.select(vector_to_array(features).alias("v"))
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = arrays.agg(*[
        F.struct(F.percentile_approx(F.col("v")[i], shares, 10_000), F.max(F.col("v")[i])).alias(f"f{i}")
        for i in range(size[0])
    ]).first()
    return [np.unique([q for q in quantiles if q < top]) for quantiles, top in found]


def coded(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """The rows with ``x`` as numbers of bins, a byte each."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2))
                codes = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())],
                    ["row", "label", "x"])

    return map_batches(rows, task, "row bigint, label int, x binary")


# --- the nodes above -------------------------------------------------------------------

@dataclass
class Top:
    """The nodes of one tree that are split by passes over all rows: splits by path
    (feature, limit, the paths below), and the paths where rows stop: ``open`` ones
    (with the number of features tried), and those grown in one task."""

    root: int
    splits: dict[int, tuple[int, float, tuple[int, int]]] = field(default_factory=dict)
    open: dict[int, int] = field(default_factory=dict)
    local: set[int] = field(default_factory=set)
    depths: dict[int, int] = field(default_factory=dict)


class Routes:
    """The splits of a Top as arrays over its nodes, the root first."""

    def __init__(self, top: Top):
        number = {path: i for i, path in enumerate(top.depths)}
        self.root = top.root
        self.paths = np.array(list(number), dtype=np.uint64)
        self.feature, self.limit = np.full(len(number), -1), np.zeros(len(number))
        self.below = np.zeros((len(number), 2), dtype=np.int64)
        for path, (feature, limit, below) in top.splits.items():
            i = number[path]
            self.feature[i], self.limit[i], self.below[i] = feature, limit, [number[x] for x in below]
        self.open = {number[path]: path for path in top.open}
        self.is_open = np.array([path in top.open for path in number])
        self.local = np.array([path in top.local for path in number])

    def reached(self, layout: Layout, words: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The number of the node at which each row stops (of ``Layout.columns``)."""
        at = np.zeros(words.shape[1], dtype=np.int64)
        going = np.arange(len(at)) if self.feature[0] >= 0 else np.empty(0, dtype=np.int64)
        slots = layout.slots
        while len(going):
            here = at[going]
            f = self.feature[here]
            slot = slots[f]
            right = ((words[0][going] if len(words) == 1 else words[slot >> 6, going]) >> (slot & 63).astype(np.uint64)
                     & np.uint64(1)).astype(np.int64)
            wide = np.flatnonzero(~layout.two[f])
            right[wide] = table[slot[wide], going[wide]] > self.limit[here[wide]]
            at[going] = here = self.below[here, right]
            going = going[self.feature[here] >= 0]
        return at

    def at_open(self, layout: Layout, words: np.ndarray, table: np.ndarray, tally: Tally, use: np.ndarray
                ) -> tuple[list[int], Held]:
        """The open nodes that rows reach, and the rows there of those in ``use``."""
        at = self.reached(layout, words, table)[use]
        on = np.flatnonzero(self.is_open[at])
        counts = np.bincount(at[on], minlength=len(self.paths))
        order = on[np.argsort(at[on].astype(np.uint16) if len(self.paths) < 1 << 16 else at[on], kind="stable")]
        nodes = np.flatnonzero(counts)
        rows = use[order]
        return [self.open[i] for i in nodes.tolist()], Held(counts[nodes], rows, words[:, rows], [p[order] for p in tally.parts])


def parts_of(at: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, those of ``rows`` that are there) by rising number."""
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
        yield int(at[a]), rows[a:b]


def _sample(growth: Growth, numbers: np.ndarray, root: int) -> np.ndarray:
    return bootstrap(numbers, np.uint64(root)) if growth.sampled else np.ones(len(numbers), dtype=np.int64)


def _kind(growth: Growth) -> str:
    return "<f8" if growth.random_cuts else "u1"


def _tried(growth: Growth, path: int, done: int, features: int) -> np.ndarray:
    return feature_order(np.array([path], dtype=np.uint64), features)[0][done:done + growth.tried]


def _told(growth: Growth, tops: dict[int, Top], features: int) -> tuple[dict[int, Routes], dict[tuple, np.ndarray]]:
    """What a pass tells its tasks: routes, and the features that each open node tries."""
    tried = {(tree, path): _tried(growth, path, done, features) for tree, top in tops.items() for path, done in top.open.items()}
    return {tree: Routes(top) for tree, top in tops.items()}, tried


def _columns(table: pa.Table, growth: Growth, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and labels of rows, and their features by ``Layout.columns``."""
    data = layout.packed(matrix(table.column(2), _kind(growth))).tobytes()
    return table.column(0).to_numpy(), table.column(1).to_numpy().astype(np.uint8), *layout.columns(data, table.num_rows)


def _ranges(rows: DataFrame, growth: Growth, routes: dict[int, Routes], tried: dict[tuple, np.ndarray], layout: Layout
            ) -> dict[tuple, tuple[float, float]]:
    """Least and largest value of the features of more than two values that open nodes try."""
    slots = layout.slots

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[float, float]] = {}
        for batch in joined(batches):
            numbers, labels, words, table = _columns(batch, growth, layout)
            for tree, route in routes.items():
                weights = _sample(growth, numbers, route.root)
                use = np.flatnonzero(weights)
                paths, there = route.at_open(layout, words, table, Tally(labels[use], weights[use], growth.sampled), use)
                pairs = [(i, path, f) for i, path in enumerate(paths) for f in tried[tree, path].tolist() if not layout.two[f]]
                if not pairs:
                    continue
                node, _, f = zip(*pairs)
                there = there.again(np.array(node))
                values, starts = there.wide(table, slots[list(f)]), there.starts
                for (_, path, f), a, b in zip(pairs, np.minimum.reduceat(values, starts).tolist(),
                                              np.maximum.reduceat(values, starts).tolist()):
                    low, high = held.get((tree, path, f), (np.inf, -np.inf))
                    held[tree, path, f] = min(low, a), max(high, b)
        if held:
            tree, path, f = zip(*held)
            low, high = zip(*held.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.int32()), pa.array(np.array(path, np.uint64).view(np.int64)), pa.array(f, pa.int32()),
                 pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["tree", "node", "feature", "low", "high"])

    cells = map_batches(rows, task, "tree int, node bigint, feature int, low double, high double")
    found = cells.groupBy("tree", "node", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return {(r.tree, r.node & (2**64 - 1), r.feature): (r.low, r.high) for r in found.collect()}


def _level_sums(held: Held, tally: Tally, layout: Layout, table: np.ndarray, tried: np.ndarray, cuts: np.ndarray | None,
                bins: int) -> np.ndarray:
    """Sums per (weight of class 0 or 1 or rows, node, place of the feature tried, bin)."""
    sums = np.zeros((3, *tried.shape, bins), dtype=np.int64)
    slots, two = layout.slots, layout.two[tried]
    n, w0, w1 = tally.read(held.sums())
    whole = np.stack([w0, w1, n])
    for place in range(tried.shape[1]):
        if two[:, place].any():
            n, w0, w1 = tally.read(held.sums(held.bits(np.where(two[:, place], slots[tried[:, place]], 0))))
            sums[:, :, place, 1] = w0, w1, n
            sums[:, :, place, 0] = whole - sums[:, :, place, 1]
    node, place = np.nonzero(~two)
    if len(node):
        there = held.again(node)
        codes = there.wide(table, slots[tried[node, place]])
        if cuts is not None:
            codes = codes > np.repeat(cuts[node, place], there.counts)
        key = np.repeat(np.arange(len(node)) * bins, there.counts) + codes
        n, w0, w1 = (np.bincount(key, x, len(node) * bins).reshape(-1, bins) for x in tally.read(there.parts))
        sums[:, node, place] = w0, w1, n
    return sums


def _level(rows: DataFrame, growth: Growth, variant: tuple, tops: dict[int, Top], features: int, layout: Layout) -> list:
    """One aggregation over all rows: the best split of every open node."""
    routes, tried_at = _told(growth, tops, features)
    ranges = _ranges(rows, growth, routes, tried_at, layout) if growth.random_cuts else {}
    bins = 2 if growth.random_cuts else BINS
    limits = {}
    if growth.random_cuts:
        for (tree, path), tried in tried_at.items():
            low, high = zip(*[ranges.get((tree, path, f), (layout.low[f], layout.high[f])) for f in tried.tolist()])
            found = random_thresholds(np.array([path], np.uint64), tried[None], np.array([low]), np.array([high]))[0]
            limits.update({(tree, path, f): limit for f, limit in zip(tried.tolist(), found.tolist())})

    cuts = {at: np.array([limits[*at, f] for f in tried.tolist()]) for at, tried in tried_at.items()
            } if growth.random_cuts else {}

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in joined(batches):
            numbers, labels, words, table = _columns(batch, growth, layout)
            for tree, route in routes.items():
                weights = _sample(growth, numbers, route.root)
                use = np.flatnonzero(weights)
                tally = Tally(labels[use], weights[use], growth.sampled)
                paths, there = route.at_open(layout, words, table, tally, use)
                by_size: dict[int, list[int]] = {}  # nodes whose last features are tried try fewer
                for i, path in enumerate(paths):
                    by_size.setdefault(len(tried_at[tree, path]), []).append(i)
                for nodes in by_size.values():
                    some = np.isin(np.arange(len(paths)), nodes)
                    sums = _level_sums(there.some(some), tally, layout, table, np.stack([tried_at[tree, paths[i]] for i in nodes]),
                                       np.stack([cuts[tree, paths[i]] for i in nodes]) if cuts else None, bins)
                    for j, i in enumerate(nodes):
                        at = tree, paths[i]
                        held[at] = held[at] + sums[:, j] if at in held else sums[:, j]
        for (tree, path), sums in held.items():
            cell = np.flatnonzero(sums[2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cell), tree, np.int32)), pa.array(np.full(len(cell), path, np.uint64).view(np.int64)),
                 pa.array(cell.astype(np.int32)), *(pa.array(s.ravel()[cell].astype(np.int64)) for s in sums)],
                ["tree", "node", "cell", "w0", "w1", "n"])

    cells = map_batches(rows, task, "tree int, node bigint, cell int, w0 bigint, w1 bigint, n bigint").groupBy(
        "tree", "node", "cell").agg(*[F.sum(c).alias(c) for c in ("w0", "w1", "n")])

    def choose(group: pa.Table) -> pa.Table:
        tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        path = node & (2**64 - 1)
        tried = tried_at[tree, path]
        w0, w1, n = np.zeros((3, len(tried) * bins))
        cell = group.column("cell").to_numpy()
        for target, name in ((w0, "w0"), (w1, "w1"), (n, "n")):
            target[cell] = group.column(name).to_numpy()
        shape = (1, len(tried), bins)
        w0, w1, n = (w0 * variant[1]).reshape(shape), (w1 * variant[2]).reshape(shape), n.reshape(shape)
        place, cut, found, l0, l1, ln = (x[0] for x in best_cuts(w0, w1, n, variant[0]))
        a0, a1, an = (float(x[0, 0].sum()) for x in (w0, w1, n))
        f = int(tried[place])
        limit = limits[tree, path, f] if growth.random_cuts else float(cut)
        pure = a0 == 0 or a1 == 0
        return pa.table({
            "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int64()),
            "feature": pa.array([f if found and not pure else -1], pa.int32()), "limit": pa.array([limit], pa.float64()),
            **{k: pa.array([float(v)]) for k, v in zip(("n", "w0", "w1", "ln", "l0", "l1"), (an, a0, a1, ln, l0, l1))},
            "pure": pa.array([pure]),
        })

    return cells.groupBy("tree", "node").applyInArrow(
        choose, "tree int, node bigint, feature int, limit double, n double, w0 double, w1 double, ln double, "
                "l0 double, l1 double, pure boolean").collect()


def _split_top(rows: DataFrame, growth: Growth, variant: tuple, trees: Sequence[int], n_rows: int, features: int,
               edges: list[np.ndarray], layout: Layout | None = None) -> tuple[dict[int, Top], list[tuple]]:
    """The upper nodes of each tree, as long as they have more than LOCAL_ROWS rows,
    and their rows in the table of nodes. Only nodes that large reach the driver."""
    tops, table = {}, []
    layout = layout or (layout_of(rows, growth) if n_rows > LOCAL_ROWS else None)
    for tree in trees:
        root = int(root_of(tree, growth.seed))
        tops[tree] = Top(root, depths={root: 0})
        if n_rows > LOCAL_ROWS:
            tops[tree].open[root] = 0
        else:
            tops[tree].local.add(root)

    def leaf(tree: int, path: int, n: float, w0: float, w1: float) -> None:
        table.append((tree, path, tops[tree].depths[path], -1, float("nan"), int(n), w0, w1))

    while any(top.open for top in tops.values()):
        active = {tree: top for tree, top in tops.items() if top.open}
        for r in _level(rows, growth, variant, active, features, layout):
            top, path = tops[r.tree], r.node & (2**64 - 1)
            if r.feature < 0:
                top.open[path] += growth.tried
                if r.pure or top.open[path] >= features or r.n < 2 * variant[0]:
                    del top.open[path]
                    leaf(r.tree, path, r.n, r.w0, r.w1)
                continue
            del top.open[path]
            depth = top.depths[path]
            sides = tuple(int(child(np.uint64(path), side)) for side in (0, 1))
            top.splits[path] = (r.feature, r.limit, sides)
            limit = r.limit if growth.random_cuts else float(edges[r.feature][int(r.limit)])
            table.append((r.tree, path, depth, r.feature, limit, int(r.n), r.w0, r.w1))
            for side, (n, w0, w1) in enumerate(((r.ln, r.l0, r.l1), (r.n - r.ln, r.w0 - r.l0, r.w1 - r.l1))):
                below = sides[side]
                top.depths[below] = depth + 1
                if n <= LOCAL_ROWS:
                    top.local.add(below)
                elif w0 == 0 or w1 == 0 or (growth.depth is not None and depth + 1 >= growth.depth):
                    leaf(r.tree, below, n, w0, w1)
                else:
                    top.open[below] = 0
    return tops, table


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A head and the rows in few bytes each: columns of at most two values are bits,
    others stay float64. Rows of bins stay as they are, with an empty head."""
    if values.dtype == np.uint8:
        return b"", values
    low, high = values.min(axis=0), values.max(axis=0)
    two = ((values == low) | (values == high)).all(axis=0)
    bits = np.packbits(values[:, two] == high[two], axis=1)
    rest = np.ascontiguousarray(values[:, ~two], dtype="<f8").view(np.uint8).reshape(len(values), -1)
    return two.tobytes() + np.stack([low, high]).astype("<f8").tobytes(), np.concatenate([bits, rest], axis=1)


def unpacked(head: bytes, data: bytes, n: int) -> np.ndarray:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(n, -1)
    if not head:
        return rows
    features = len(head) // 17
    two = np.frombuffer(head, dtype=bool, count=features)
    low, high = np.frombuffer(head, dtype="<f8", offset=features).reshape(2, features)
    values, wide = np.empty((n, features)), -(-int(two.sum()) // 8)
    values[:, two] = np.where(np.unpackbits(rows[:, :wide], axis=1, count=int(two.sum())), high[two], low[two])
    values[:, ~two] = np.ascontiguousarray(rows[:, wide:]).view("<f8").reshape(n, -1)
    return values


def layout_of(rows: DataFrame, growth: Growth) -> Layout:
    """Which features have at most two values, by one pass over the rows: a task tells at
    most three values of each."""
    kind = _kind(growth)

    def least(values: np.ndarray) -> np.ndarray:
        """Per column the smallest, the largest and one between, or the smallest again."""
        low, high = values.min(axis=0), values.max(axis=0)
        between = np.where((values != low) & (values != high), values, low).max(axis=0)
        return np.stack([low, high, between])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in joined(batches):
            found = least(matrix(batch.column(2), kind))
            held = found if held is None else least(np.concatenate([held, found]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.astype("<f8").tobytes()], pa.binary())], ["v"])

    found = np.concatenate([np.frombuffer(r.v, "<f8").reshape(3, -1) for r in map_batches(rows, task, "v binary").collect()])
    low, high = found.min(axis=0), found.max(axis=0)
    two = ((found == low) | (found == high)).all(axis=0)
    if not growth.random_cuts:
        two, low, high = high <= 1, np.zeros_like(low), np.ones_like(high)
    return Layout(two, low, high, kind)


def _dealt(rows: DataFrame, growth: Growth, tops: dict[int, Top], layout: Layout | None = None) -> DataFrame:
    """Each tree's rows with the node below which they are grown in one task; the rows
    of a batch that go to one node travel together, as ``layout`` has them."""
    layout = layout or layout_of(rows, growth)
    routes = {tree: Routes(top) for tree, top in tops.items() if top.local}
    names = ["tree", "node", "labels", "weights", "x"]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = [], 0
        for batch in joined(batches):
            numbers, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint8)
            data = layout.packed(matrix(batch.column(2), _kind(growth)))
            words, table = layout.columns(data.tobytes(), len(labels))
            for tree, route in routes.items():
                weights = _sample(growth, numbers, route.root).astype(np.uint8)
                use = np.flatnonzero(weights)
                at = route.reached(layout, words, table)[use]
                on = np.flatnonzero(route.local[at])
                for number, some in parts_of(at[on], use[on]):
                    x = data[some].tobytes()
                    node = int(route.paths[number:number + 1].view(np.int64)[0])
                    told = weights[some].tobytes() if growth.sampled else b""
                    pieces.append((tree, node, labels[some].tobytes(), told, x))
                    size += len(x) + 2 * len(some)
                if size > PIECES_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names)
                    pieces, size = [], 0
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names)

    return map_batches(rows, task, "tree int, node bigint, labels binary, weights binary, x binary")


def _below(dealt: DataFrame, growth: Growth, numbers: Sequence[int], tops: dict[int, Top], layout: Layout,
           edges: list[np.ndarray]) -> DataFrame:
    """A piece per variant and dealt node."""
    depths = {(tree, path): top.depths[path] for tree, top in tops.items() for path in top.local}

    def grow(group: pa.Table) -> pa.Table:
        tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        path = np.uint64(node & (2**64 - 1))
        labels, weights = (np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=np.uint8).astype(np.int64)
                           for c in ("labels", "weights"))
        words, table = layout.columns(b"".join(group.column("x").to_pylist()), len(labels))
        weights, depth = weights if growth.sampled else np.ones_like(labels), depths[tree, int(path)]
        pieces = []
        for number, variant in zip(numbers, growth.variants):
            found = grow_below(growth, variant, path, depth, layout, words, table, labels, weights, edges)
            pieces.append((number, tree, node, depth, False, len(found["n"]), piece_bytes(found)))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*pieces), _PIECE_KINDS)], names=_PIECE_NAMES)

    groups = max(1, len(depths))
    return dealt.repartition(2 * groups, "tree", "node").groupBy("tree", "node").applyInArrow(grow, PIECES)


_PIECE_NAMES = ["variant", "tree", "node", "depth", "top", "size", "data"]
_PIECE_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]


def _top_pieces(number: int, table: list[tuple]) -> list[tuple]:
    """The nodes above, a piece per tree, the root first."""
    by_tree: dict[int, list[tuple]] = {}
    for tree, *node in table:
        by_tree.setdefault(tree, []).append(node)
    pieces = []
    for tree, nodes in by_tree.items():
        columns = zip(*sorted(nodes, key=lambda r: r[1]))
        found = {c: np.array(v, np.uint64 if c == "node" else None) for c, v in zip(
            ("node", "depth", "feature", "threshold", "n", "w0", "w1"), columns)}
        root = int(found["node"][:1].view(np.int64)[0])
        pieces.append((number, tree, root, 0, True, len(nodes), piece_bytes(found, True)))
    return pieces


def grow_pieces(rows: DataFrame, growth: Growth, n_rows: int, features: int, edges: list[np.ndarray] = (),
                name: str = "forest") -> DataFrame:
    """The written table of pieces (``PIECES``) of every variant and tree: per tree the nodes split
    by passes over all rows, if any, and what is below each of them.

    ``rows`` are a written table of ``feature_rows`` (with random cuts) or ``coded`` ones. Of
    what grows with the data only nodes with more than LOCAL_ROWS rows reach the
    driver, for as many trees at a time as keep that below TOP_NODES; rows are dealt to as
    many trees at a time as keep that near DEALT_BYTES."""
    above = max(1, 4 * n_rows // LOCAL_ROWS)
    batch = max(1, TOP_NODES // above)
    layout = layout_of(rows, growth)
    lot = max(1, DEALT_BYTES // max(1, n_rows * (layout.width + 2)))
    shared = n_rows <= LOCAL_ROWS  # no node above depends on the variant
    told = [(list(range(len(growth.variants))), growth)] if shared else [
        ([i], Growth(**{**growth.__dict__, "variants": (v,)})) for i, v in enumerate(growth.variants)]
    found = []
    for numbers, own in told:
        for first in range(0, growth.trees, batch):
            trees = range(first, min(growth.trees, first + batch))
            tops, table = _split_top(rows, own, own.variants[0], trees, n_rows, features, edges, layout)
            for start in range(0, len(trees), lot):
                some = {tree: tops[tree] for tree in trees[start:start + lot]}
                with shuffles_dropped(rows.sparkSession):
                    found.append(pin(_below(_dealt(rows, own, some, layout), own, numbers, some, layout, edges), name))
            if table:
                found.append(pin(rows.sparkSession.createDataFrame(_top_pieces(numbers[0], table), PIECES), name))
    return reduce(DataFrame.unionByName, found)


def grow_forest(rows: DataFrame, growth: Growth, n_rows: int, features: int, edges: list[np.ndarray] = (),
                name: str = "forest") -> DataFrame:
    """The table of nodes (``NODES``) of every variant and tree, from written pieces; ``feature`` is -1
    at a leaf, ``n`` counts a node's rows and ``w0``, ``w1`` are its class weights."""
    return nodes_of(grow_pieces(rows, growth, n_rows, features, edges, name))


# --- pruning and scoring -----------------------------------------------------------------

@dataclass(frozen=True)
class Pruned:
    """A forest cut to the first ``trees``, to ``depth``, and to splits of nodes with
    ``split`` rows and more."""

    trees: int
    depth: int | None = None
    split: int = 2


class Tree:
    """One tree's nodes as arrays. ``below`` are the places of the nodes below, if known."""

    def __init__(self, nodes: dict[str, np.ndarray], below: np.ndarray | None = None):
        self.depth, self.feature, self.threshold, self.n, w0, w1 = (
            nodes[c] for c in ("depth", "feature", "threshold", "n", "w0", "w1"))
        self.share = w1 / (w0 + w1)
        inner = np.flatnonzero(self.feature >= 0)
        inner = inner[np.argsort(self.depth[inner], kind="stable")]
        self.levels = np.split(inner, np.flatnonzero(np.diff(self.depth[inner])) + 1)
        self.below = below
        if below is None:
            paths = nodes["node"].view(np.uint64)
            order = np.argsort(paths)
            self.below = np.full((len(paths), 2), -1)
            for side in (0, 1):
                self.below[inner, side] = order[np.searchsorted(paths, child(paths[inner], side), sorter=order)]
        self.root = int(np.flatnonzero(self.depth == 0)[0])

    @classmethod
    def of_pieces(cls, pieces: list[dict[str, np.ndarray]]) -> Tree:
        if len(pieces) == 1:
            return cls(pieces[0], pieces[0]["below"])
        return cls({c: np.concatenate([p[c] for p in pieces]) for c in (
            "node", "depth", "feature", "threshold", "n", "w0", "w1")})

    def leaves(self, values: np.ndarray) -> np.ndarray:
        at = np.full(len(values), self.root)
        going = np.arange(len(values))
        while len(going):
            here = at[going]
            going = going[self.feature[here] >= 0]
            here = at[going]
            right = values[going, self.feature[here]] > self.threshold[here]
            at[going] = self.below[here, right.astype(np.int64)]
        return at

    def shares(self, cut: Pruned) -> np.ndarray:
        """Per node the share of class 1 at the node where the pruned tree stops on the
        way to it."""
        stop = self.n < cut.split
        if cut.depth is not None:
            stop |= self.depth >= cut.depth
        share, stopped = self.share.copy(), stop.copy()
        for level in self.levels:
            above = level[stopped[level]]
            share[self.below[above]] = share[above, None]
            stopped[self.below[above]] = True
        return share


def trees_of(table: pa.Table) -> Iterator[tuple[int, int, Tree]]:
    """(variant, tree number, tree) of a table of whole trees."""
    columns = {c: table.column(c).to_numpy() for c in ("variant", "tree", "node", "depth", "feature", "threshold", "n", "w0", "w1")}
    order = np.lexsort((columns["tree"], columns["variant"]))
    columns = {c: v[order] for c, v in columns.items()}
    changed = (np.diff(columns["variant"]) != 0) | (np.diff(columns["tree"]) != 0)
    starts = np.concatenate(([0], np.flatnonzero(changed) + 1, [len(order)]))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield int(columns["variant"][a]), int(columns["tree"][a]), Tree({c: v[a:b] for c, v in columns.items()})


def forest_scores(nodes: DataFrame, rows: DataFrame, n_rows: int, trees: int, settings: Sequence[Pruned]) -> DataFrame:
    """(row, variant, scores): the mean share of class 1 over the trees of each setting, from
    a table of nodes."""

    def piece(group: pa.Table) -> pa.Table:
        pieces = []
        for variant, tree, _ in trees_of(group):
            found = {c: group.column(c).to_numpy() for c in ("node", "depth", "feature", "threshold", "n", "w0", "w1")}
            root = int(found["node"][found["depth"] == 0][0])
            pieces.append((variant, tree, root, 0, True, group.num_rows, piece_bytes(found, True)))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*pieces), _PIECE_KINDS)], names=_PIECE_NAMES)

    return piece_scores(nodes.groupBy("variant", "tree").applyInArrow(piece, PIECES), rows, n_rows, trees, settings)


def piece_scores(pieces: DataFrame, rows: DataFrame, n_rows: int, trees: int, settings: Sequence[Pruned]) -> DataFrame:
    """(row, variant, scores) of a table of pieces.

    A lot of trees of a variant (at most LOT_NODES nodes, or one tree) meets a block of rows in one
    task; sums over lots are added. Settings that only differ in the number of trees share
    sums where all trees of a lot count for each of them or for none."""
    sizes = {r.variant: r.size for r in pieces.groupBy("variant").agg(F.sum("size").alias("size")).collect()}
    per_lot = {v: max(1, min(TREE_LOT, trees * LOT_NODES // max(1, n))) for v, n in sizes.items()}
    blocks = max(1, -(-n_rows // ROW_BLOCK))
    ends = sorted({min(c.trees, trees) for c in settings})
    shapes = list(dict.fromkeys((c.depth, c.split) for c in settings))
    cuts = [Pruned(trees, *shape) for shape in shapes]
    steps = []  # (variant, first tree, last tree, the number of ``ends`` up to which it is left out)
    for variant, size in sorted(per_lot.items()):
        for i, end in enumerate(ends):
            begin = ends[i - 1] if i else 0
            steps += [(variant, a, min(end, a + size), i) for a in range(begin, end, size)]
    lot_of = F.create_map(*[x for lot, (v, a, b, _) in enumerate(steps) for t in range(a, b) for x in (
        F.lit(v * trees + t), F.lit(lot))])
    width = len(cuts)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches):
            numbers, data = batch.column("row").to_numpy(), matrix(batch.column("x"))
            block = (mixed(numbers.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            for at, some in parts_of(block, np.arange(len(numbers))):
                head, x = packed(data[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int32()), *(pa.array([v], pa.binary()) for v in (
                        numbers[some].astype("<i8").tobytes(), head, x.tobytes()))], ["block", "rows", "head", "x"])

    def score(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not (held.num_rows and asked.num_rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32()),
                             pa.array([], pa.list_(pa.float64()))], names=["row", "variant", "step", "sums"])
        numbers = [np.frombuffer(r, "<i8") for r in asked.column("rows").to_pylist()]
        values = np.concatenate([unpacked(head, x, len(some)) for head, x, some in zip(
            asked.column("head").to_pylist(), asked.column("x").to_pylist(), numbers)])
        numbers = np.concatenate(numbers)
        variant, _, _, step = steps[held.column("lot")[0].as_py()]
        total = np.zeros((width, len(values)))
        by_tree: dict[int, list[int]] = {}
        for i, tree in enumerate(held.column("tree").to_pylist()):
            by_tree.setdefault(tree, []).append(i)
        for _, places in sorted(by_tree.items()):
            found = []
            for i in places:
                found.append(piece_nodes(*(held.column(c)[i].as_py() for c in ("node", "depth", "top", "size", "data"))))
            tree = Tree.of_pieces(found)
            leaves = tree.leaves(values)
            for i, cut in enumerate(cuts):
                total[i] += tree.shares(cut)[leaves]
        total = np.ascontiguousarray(total.T).ravel()
        return pa.table([
            pa.array(numbers), pa.array(np.full(len(values), variant, np.int32)), pa.array(np.full(len(values), step, np.int32)),
            pa.ListArray.from_arrays(np.arange(0, total.size + 1, width, dtype=np.int32), pa.array(total))],
            names=["row", "variant", "step", "sums"])

    held = pieces.where(F.col("tree") < max(ends)).withColumn("lot", lot_of[F.col("variant") * trees + F.col("tree")])
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = map_batches(rows.select("row", "x"), pack, "block int, rows binary, head binary, x binary").withColumn(
        "lot", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    tasks = 2 * len(steps) * blocks
    parts = held.repartition(tasks, "lot", "block").groupBy("lot", "block").cogroup(
        asked.repartition(tasks, "lot", "block").groupBy("lot", "block")).applyInArrow(
        score, "row bigint, variant int, step int, sums array<double>")
    sums = [F.sum(F.when(F.col("step") <= ends.index(min(c.trees, trees)), F.col("sums")[shapes.index((c.depth, c.split))]))
            for c in settings]
    return parts.groupBy("row", "variant").agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).select(
        "row", "variant", F.array(*[F.round(F.col(f"s{i}") / c.trees, 12) for i, c in enumerate(settings)]).alias("scores"))


# --- extremely randomised trees -------------------------------------------------------------

class ExtraTrees(Estimator):
    """Extremely randomised trees: every tree sees all rows; at a node a random subset of
    features is tried, each with one threshold drawn uniformly from the node's range
    of it, and the best of these splits by Gini impurity is taken. Trees grow
    until leaves are pure or can't be split, unless ``depth`` ends them."""

    def __init__(self, trees: int = 300, depth: int | None = None, min_leaf: int = 1, seed: int = RANDOM_SEED):
        super().__init__()
        self.trees, self.depth, self.min_leaf, self.seed = trees, depth, min_leaf, seed

    def _fit(self, df: DataFrame) -> ForestModel:
        rows = pin(feature_rows(df, "monotonically_increasing_id()"), "extra-rows")
        shape = rows.agg(F.count(F.lit(1)), F.max(F.length("x"))).first()
        features = shape[1] // 8
        growth = Growth(self.trees, max(1, int(features**0.5)), True, False, self.depth,
                        ((self.min_leaf, 1.0, 1.0),), self.seed)
        return ForestModel(grow_pieces(rows, growth, shape[0], features, name="extra-trees"), self.trees)


class ForestModel(Model):
    """Adds ``probability`` and ``prediction`` from a table of pieces."""

    def __init__(self, pieces: DataFrame, trees: int):
        super().__init__()
        self.pieces, self.trees = pieces, trees

    @property
    def nodes(self) -> DataFrame:
        return nodes_of(self.pieces)

    def _transform(self, df: DataFrame) -> DataFrame:
        asked = pin(df.withColumn("_row", F.monotonically_increasing_id()), "forest-asked")
        rows = feature_rows(asked.withColumn("_none", F.lit(0)), "_row", "_none")
        scores = piece_scores(self.pieces, rows, asked.count(), self.trees, [Pruned(self.trees)])
        one = F.col("scores")[0]
        judged = scores.select(F.col("row").alias("_row"), array_to_vector(F.array(1 - one, one)).alias("probability"),
                               (one > 0.5).cast("double").alias("prediction"))
        return asked.join(judged, "_row").drop("_row")
