"""Hard negatives by Fagin's threshold algorithm.

Rows lie in blocks. In a block each dimension has a list of the rows sorted by
that component. An anchor reads the lists in step, from the end its own sign
favours (sorted access); every row it meets is scored once, in integers (random
access). No row it has not met can score more than the sum of what the lists
stand at, the threshold; reading stops once that is strictly below the k-th
score of every window. The blocks' results are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.common import find_package, map_batches, table
from tenura.llm.vectors import matrices, stacked
from tenura.sources.shared import pin

BLOCK = 4096  # rows with lists of their own
LOT = 2048  # anchors that read a block in one task
DEPTH = 8  # rows of each list read first; doubled from step to step
SCALE = 256
EXACT = float(2**53)
LOWEST = np.iinfo(np.int64).min
HIGHEST = np.iinfo(np.int64).max
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90  # percent of the positive's score


@dataclass
class Span:
    """The best ``size`` rows whose score times ``times`` is within ``low`` and ``high``."""

    low: int
    high: int
    size: int
    times: int = 1


class Lists:
    """A block's rows with its sorted lists, both ways."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.top = np.abs(values).max(initial=0)
        rising = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
        self.orders = np.stack([rising[:, ::-1], rising])  # falling for positive components

    @cached_property
    def whole(self) -> np.ndarray:
        return self.values.astype(np.int64)

    def _small(self, most: float) -> bool:
        return bool(self.top * most * self.values.shape[1] < EXACT)

    def search(self, anchor: np.ndarray, windows: list[Span], able: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray]:
        """(rows met, their scores) with every row of each window's best, ties
        included. ``able`` marks the rows that may be results."""
        n = len(self.values)
        use = np.flatnonzero(anchor)
        if not len(use):  # every row scores 0
            found = np.arange(n) if able is None else np.flatnonzero(able)
            return found, np.zeros(len(found), dtype=np.int64)
        small = self._small(np.abs(anchor).max())
        weights = anchor[use] if small else anchor[use].astype(np.int64)
        data = self.values if small else self.whole
        lists = (anchor[use] < 0).astype(np.int64)
        met = np.zeros(n, dtype=bool)
        scores = np.full(n, LOWEST)
        begin, end = 0, min(DEPTH, n)
        while True:
            read = self.orders[lists, use, begin:end]
            fresh = np.zeros(n, dtype=bool)
            fresh[read] = True
            fresh = np.flatnonzero(fresh & ~met)
            met[fresh] = True
            if able is not None:
                fresh = fresh[able[fresh]]
            scores[fresh] = (data[np.ix_(fresh, use)] @ weights).astype(np.int64)
            if end == n:
                break
            reached = data[read[:, -1], use]
            if self._done(int(reached @ weights), scores, windows):
                break
            begin, end = end, min(2 * end, n)
        found = np.flatnonzero(scores > LOWEST)
        return found, scores[found]

    @staticmethod
    def _done(threshold: int, scores: np.ndarray, windows: list[Span]) -> bool:
        for w in windows:
            if threshold * w.times < w.low:
                continue  # nothing to come is in the window
            inside = scores[(scores > LOWEST) & inside_of(scores, w)]
            if len(inside) < w.size:
                return False
            if threshold >= np.partition(inside, -w.size)[-w.size]:
                return False
        return True


def inside_of(scores: np.ndarray, w: Span) -> np.ndarray:
    """Whether scores are in the window, in whole numbers."""
    if w.low > w.high:
        return np.zeros(len(scores), dtype=bool)
    low = -(-w.low // w.times)
    high = w.high // w.times
    return (scores >= max(low, LOWEST)) & (scores <= min(high, HIGHEST))


def best_of(ids: np.ndarray, scores: np.ndarray, size: int) -> np.ndarray:
    """Places of the ``size`` best by score, then by id."""
    if len(scores) > size:
        bound = np.partition(scores, -size)[-size]
        at = np.flatnonzero(scores >= bound)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:size]


def numbered_vectors(df: DataFrame, asks: Column, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, label, asks, size, vec): every row with a number of its own and its
    vector, scaled to whole numbers, as float64 bytes. Rows that take no part are left out."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            size = np.zeros(batch.num_rows, dtype=np.int32)
            for rows, values in matrices(batch.column(4)):
                size[rows] = values.shape[1]
                with np.errstate(over="ignore"):
                    values = np.ascontiguousarray(np.floor(SCALE * values) + 0.0, dtype="<f8")
                for row, value in zip(rows.tolist(), values):
                    out[row] = value.tobytes()
            columns = [*batch.columns[:4], pa.array(size), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "label", "asks", "size", "vec"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                     F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label",
                       F.coalesce(asks, F.lit(False)).alias("asks"), "v")
    return map_batches(rows, task, "row bigint, id bigint, label bigint, asks boolean, size int, vec binary"
                       ).filter("vec IS NOT NULL")


def met_in_blocks(rows: DataFrame, asked: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors with equal ``keys``, both with ``part`` and ``lot``: each lot of
    anchors meets each part of the rows once. No part has more than about BLOCK rows,
    no lot more than about LOT anchors; a large key is one of many parts, and
    the list of such keys is written first."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("m"))
    cut = counts.filter((F.col("n") > BLOCK) | (F.col("m") > LOT)).select(
        *keys, F.ceil(F.col("n") / BLOCK).alias("parts"), F.greatest(F.ceil(F.col("m") / LOT), F.lit(1)).alias("lots"))
    large = pin(cut, f"{name}-large")
    hashed = F.xxhash64("row")

    def dealt(df: DataFrame, own: str, of: str, other: str, others: str) -> DataFrame:
        joined = df.join(large, keys, "left")
        own_parts, other_parts = (F.coalesce(c, F.lit(1)) for c in (of, others))
        return (
            joined.withColumn(own, F.pmod(hashed, own_parts).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), other_parts.cast("int") - 1))).drop("parts", "lots")
        )

    return dealt(rows, "part", "parts", "lot", "lots"), dealt(asked, "lot", "lots", "part", "parts")


def _found(columns: dict[str, list[np.ndarray]]) -> pa.Table:
    return pa.table({c: pa.array(np.concatenate(v) if v else np.empty(0, dtype=np.int64), pa.int64())
                     for c, v in columns.items()})


def positives(rows: DataFrame, count: int, name: str) -> DataFrame:
    """(anchor, place, positive_id, positive_score): the anchor's ``count`` best other
    rows of its label, best first."""
    find_package(rows.sparkSession)

    def solve(asked: pa.Table, block: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor", "positive_id", "positive_score")}
        if asked.num_rows and block.num_rows:
            lists = Lists(stacked(block.column("vec")))
            ids, numbers = block.column("id").to_numpy(), block.column("row").to_numpy()
            for own, vector in zip(asked.column("row").to_pylist(), stacked(asked.column("vec"))):
                at, scores = lists.search(vector, [Span(LOWEST, HIGHEST, count)], numbers != own)
                best = best_of(ids[at], scores, count)
                out["anchor"].append(np.full(len(best), own))
                out["positive_id"].append(ids[at[best]])
                out["positive_score"].append(scores[best])
        return _found(out)

    keys = ["label", "size"]
    anchors = pin(rows.filter("asks").select("row", "label", "size", "vec"), f"{name}-anchors")
    data, asked = met_in_blocks(rows, anchors, keys, f"{name}-positives")
    keys += ["part", "lot"]
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(
        solve, "anchor bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count)


def negatives(rows: DataFrame, windows: DataFrame, count: int, least: int, most: int, name: str) -> DataFrame:
    """(anchor, place, negative_id, negative_score, rank): of each anchor and positive
    the ``count`` best rows of other labels in the window of the positive's score."""
    find_package(rows.sparkSession)

    def solve(asked: pa.Table, block: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor", "place", "negative_id", "negative_score")}
        if asked.num_rows and block.num_rows:
            lists = Lists(stacked(block.column("vec")))
            ids, labels = block.column("id").to_numpy(), block.column("label").to_numpy()
            columns = [asked.column(c).to_pylist() for c in ("row", "label", "windows")]
            for own, label, given, vector in zip(*columns, stacked(asked.column("vec"))):
                some = {w["place"]: Span(least * w["score"], most * w["score"], count, 100) for w in given}
                some = {place: w for place, w in some.items() if w.low <= w.high}
                if not some:
                    continue
                at, scores = lists.search(vector, list(some.values()), labels != label)
                for place, w in some.items():
                    inside = at[inside_of(scores, w)]
                    own_scores = scores[inside_of(scores, w)]
                    best = best_of(ids[inside], own_scores, count)
                    out["anchor"].append(np.full(len(best), own))
                    out["place"].append(np.full(len(best), place))
                    out["negative_id"].append(ids[inside[best]])
                    out["negative_score"].append(own_scores[best])
        return _found(out)

    given = windows.groupBy("anchor").agg(
        F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("windows"))
    asked = rows.filter("asks").select("row", "label", "size", "vec").join(
        given.withColumnRenamed("anchor", "row"), "row")
    data, asked = met_in_blocks(rows, pin(asked, f"{name}-asked"), ["size"], f"{name}-negatives")
    keys = ["size", "part", "lot"]
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(
        solve, "anchor bigint, place bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def hard_negatives(df: DataFrame, asks: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least: int = LEAST,
                   most: int = MOST, name: str = "negatives") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score,
    positive_rank): for each row where ``asks`` holds (a condition on ``id``) and each of
    its ``n_positives`` best rows of the same label, the ``n_negatives`` best rows of
    other labels that score between ``least`` and ``most`` percent of the positive.

    The score is the inner product of vectors scaled to whole numbers (floor of 256
    times the component), exact within a bigint; ties go to the smaller id. Rows
    without id or label, and vectors that are null, empty or hold null or non-finite
    components, take no part; vectors of different lengths don't meet. Rows are never
    merged by id: an id that repeats is as many anchors, positives and negatives,
    and equal rows give equal results. An anchor without positives, or without
    negatives in a window, gives no row; an empty table gives none."""
    rows = pin(numbered_vectors(df, asks, label, id_col, vector_col), f"{name}-rows")
    best = pin(positives(rows, n_positives, name), f"{name}-positives")
    found = negatives(rows, best.select("anchor", "place", "positive_score"), n_negatives, least, most, name)
    anchors = rows.filter("asks").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    named = best.join(anchors, "anchor").select("anchor", "place", "anchor_id", "positive_id", "positive_score")
    return found.join(named, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
        F.col("place").alias("positive_rank"))


def op13_hard_negatives(spark, data_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, against all rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, data_dir, "embeddings"), F.col("id") % 100 == 0, label)


# Meant for small tables: it scores all pairs of an anchor and a row.
OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS g
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, CAST(list_dot_product(a.g, d.g) AS BIGINT) AS score
  FROM v a JOIN v d ON a.vec_id <> d.vec_id AND len(a.g) = len(d.g)
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
  FROM scored WHERE same
), ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, p.positive_rank, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_rank ORDER BY n.score DESC, n.vec_id) AS "rank"
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
  WHERE p.positive_rank <= 5
)
SELECT anchor_id, positive_id, CAST("rank" AS INTEGER) AS "rank", negative_id, positive_score, negative_score,
       CAST(positive_rank AS INTEGER) AS positive_rank
FROM ranked WHERE "rank" <= 10
"""
