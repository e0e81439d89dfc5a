"""Exact top-k by inner product: a Voronoi join over pivots.

Every vector belongs to the cell of its nearest pivot. Cell summaries (rows,
radius, norms, distances of the k+1 rows nearest to the pivot) give each query a
score that its k-th result reaches at least, and each cell a score that none
of its rows exceeds. A query travels only to cells whose bound reaches its own;
there it is solved locally, and the partial results are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.common import find_package, map_batches, table
from tenura.llm.vectors import byte_vectors, stacked
from tenura.sources.shared import pin

PIVOTS = 64  # sample of vectors, the bound of what the driver holds
DATA_BLOCK = 1024  # rows of a cell solved together
QUERY_BLOCK = 2048
EXACT = float(2**53)


def scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(256 * values)


def _apart(values: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (values**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * values @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = stacked(batch.column(1))
            apart = _apart(values, pivots)
            cell = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)),
                 pa.array(apart[np.arange(len(cell)), cell]), pa.array(np.linalg.norm(values, axis=1))],
                ["id", "vec", "row", "asks", "cell", "apart", "norm"])

    return map_batches(rows.select("id", "vec", "row", "asks"), task,
                       "id bigint, vec binary, row bigint, asks boolean, cell int, apart double, norm double")


def _nearest_distances(cells: DataFrame, k: int) -> DataFrame:
    """(cell, near): the k+1 smallest distances to the pivot. Each task sends
    at most that many per cell."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, apart = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                best[c] = np.sort(np.append(best.get(c, []), apart[cell == c]))[: k + 1]
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), pa.int32()), pa.array([b.tolist() for b in best.values()])], ["cell", "near"])

    some = map_batches(cells.select("cell", "apart"), task, "cell int, near array<double>")
    return some.groupBy("cell").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))


def _needed(queries: DataFrame, pivots: np.ndarray, summary: list, k: int) -> DataFrame:
    """(id, vec, row, cells): the cells that may hold one of the query's results."""
    numbers = np.array([s.cell for s in summary])
    centre = pivots[numbers]
    length = np.linalg.norm(centre, axis=1)
    radius, low, high = (np.array([s[c] for s in summary]) for c in ("radius", "low", "high"))
    near = [np.array(s.near) for s in summary]
    owner = np.repeat(np.arange(len(near)), [len(x) for x in near])
    near = np.concatenate(near)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 1000):
                values = stacked(batch.column(1).slice(at, 1000))
                norm = np.linalg.norm(values, axis=1)[:, None]
                product, apart = values @ centre.T, _apart(values, centre)
                # Far above the rounding of the sums, far below a step of 1 in a score.
                slack = 1e-9 * (norm * (length + radius)[None] + norm**2 + high[None] ** 2) + 1e-6
                most = np.minimum(product + norm * radius,
                                  (norm**2 + high**2 - np.maximum(apart - radius, 0) ** 2) / 2) + slack
                some = np.maximum(product[:, owner] - norm * near,
                                  (norm**2 + low[owner] ** 2 - (apart[:, owner] + near) ** 2) / 2) - slack[:, owner]
                # One of the rows may be the query itself, so k+1 of them are needed.
                if some.shape[1] > k:
                    reached = np.partition(some, -(k + 1), axis=1)[:, -(k + 1)][:, None]
                else:
                    reached = np.full((len(values), 1), -np.inf)
                out += [numbers[x].tolist() for x in most >= reached]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))],
                                             ["id", "vec", "row", "cells"])

    return map_batches(queries.select("id", "vec", "row"), task, "id bigint, vec binary, row bigint, cells array<int>")


def best_of_block(queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int,
                  rows: np.ndarray | None = None):
    """(query row, id, score) arrays of each query's k best in a block: by score, then
    smaller id, never its own row (``rows`` are the ids if not given). Integer
    vectors; sums are exact."""
    order = np.argsort(ids, kind="stable")
    rows = (ids if rows is None else rows)[order]
    data, ids = data[order], ids[order]
    if np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * data.shape[1] < EXACT:
        scores = (queries @ data.T).astype(np.int64)
    else:
        scores = queries.astype(np.int64) @ data.astype(np.int64).T
    lowest = np.iinfo(np.int64).min
    scores[query_rows[:, None] == rows[None]] = lowest
    take = min(k, len(ids))
    bound = np.partition(scores, len(ids) - take, axis=1)[:, len(ids) - take]
    found = []
    for row, score in enumerate(scores):
        at = np.flatnonzero((score >= bound[row]) & (score > lowest))
        at = at[np.argsort(-score[at], kind="stable")][:k]
        found.append((np.full(len(at), query_rows[row]), ids[at], score[at]))
    return [np.concatenate(x) for x in zip(*found)]


def _solved(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    find_package(data.sparkSession)

    def solve(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty(0, dtype=np.int64)] * 3
        if len(asked) and len(rows):
            out = best_of_block(stacked(pa.array(asked["vec"])), asked["row"].to_numpy(),
                                stacked(pa.array(rows["vec"])), rows["id"].to_numpy(), k, rows["row"].to_numpy())
        return pd.DataFrame(dict(zip(("query", "vec_id", "score"), out)))

    keys = ["cell", "part", "lot"]
    return queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(
        solve, "query bigint, vec_id bigint, score bigint")


def _lots(counts: dict[int, int], size: int, column: str) -> Column:
    """Number of lots of a cell's rows, from the few counts the driver holds."""
    pairs = [F.lit(x) for c, n in counts.items() for x in (c, max(1, -(-n // size)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(column)), F.lit(1)) if pairs else F.lit(1)


def _one_length(rows: DataFrame, k: int, name: str) -> DataFrame:
    sample = rows.select("vec").orderBy(F.xxhash64("id"), "id", "vec").limit(PIVOTS).collect()
    pivots = np.unique(np.frombuffer(b"".join(r.vec for r in sample), dtype="<f8").reshape(len(sample), -1), axis=0)
    cells = pin(_assigned(rows, pivots), f"{name}-cells")
    summary = (
        cells.groupBy("cell").agg(F.count("*").alias("rows"), F.max("apart").alias("radius"),
                                  F.min("norm").alias("low"), F.max("norm").alias("high"))
        .join(_nearest_distances(cells, k), "cell").collect()
    )
    asked = pin(_needed(cells.filter("asks"), pivots, summary, k), f"{name}-asked")
    sent = asked.select("id", "vec", "row", F.explode("cells").alias("cell"))
    queries_in = {r.cell: r["count"] for r in sent.groupBy("cell").count().collect()}
    parts = _lots({s.cell: s.rows for s in summary}, DATA_BLOCK, "cell")
    lots = _lots(queries_in, QUERY_BLOCK, "cell")
    hashed = F.xxhash64("row")
    queries = (
        sent.withColumn("lot", F.pmod(hashed, lots).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    )
    data = (
        cells.select("id", "vec", "row", "cell").filter(F.col("cell").isin(list(queries_in)))
        .withColumn("part", F.pmod(hashed, parts).cast("int"))
        .withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1)))
    )
    return _solved(data, queries, k)


def top_k(df: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding",
          k: int = 5, name: str = "knn") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``asks`` holds, the k
    other rows with the highest inner product of vectors scaled to integers
    (floor of 256 times the component), ties to the smaller id.

    ``asks`` is a condition on ``id``. Results are exact for scores within a
    bigint. Vectors that are null, empty, or hold null or non-finite components,
    and rows without id, take no part; vectors of different lengths have no inner
    product and are searched apart. Rows equal in id and vector count once; an id with
    several vectors asks and is found with each, its own row excepted.
    A cell with many rows or queries is cut into blocks.
    """
    vectors = byte_vectors(df, id_col, vector_col, scaled).filter("vec IS NOT NULL")
    rows = vectors.withColumn("asks", F.coalesce(asks, F.lit(False)))
    rows = pin(rows.withColumn("row", F.monotonically_increasing_id()), f"{name}-rows")
    found = None
    for size, in rows.select(F.length("vec")).distinct().collect():
        part = _one_length(rows.filter(F.length("vec") == size), k, name)
        found = part if found is None else found.union(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "query bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = rows.filter("asks").select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")


def op2_exact_top_k(spark, data_dir: str) -> DataFrame:
    """Five best others for every fiftieth embedding, against all rows."""
    return top_k(table(spark, data_dir, "embeddings"), F.col("id") % 50 == 0)
