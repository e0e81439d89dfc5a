"""Near-duplicate vectors by random-hyperplane signs, checked by exact cosine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import in_blocks, map_batches, sorted_groups, spanning, table
from tenura.llm.components import connected_components
from tenura.llm.vectors import byte_vectors, stacked
from tenura.sources.shared import pin

SEED = 20240607
BLOCK = 512


def hyperplanes(length: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, length]).standard_normal((length, tables * bits))


def signatures(values: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(rows, tables) of ``bits`` sign bits each."""
    signs = (values @ hyperplanes(values.shape[1], tables, bits) > 0).reshape(len(values), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _keyed(nodes: DataFrame, tables: int, bits: int) -> DataFrame:
    """A row per vector and table; ``marks`` holds all signatures of the vector."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) // 8 for v in batch.column(2).to_pylist()])
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                for at in range(0, len(rows), 1000):
                    some = batch.take(pa.array(rows[at:at + 1000]))
                    found = signatures(stacked(some.column(2)), tables, bits)
                    key = (length << 40) | (np.arange(tables, dtype=np.int64) << 32) | found
                    marks = pa.array([m.tobytes() for m in found.astype("<u4")], pa.binary())
                    take = pa.array(np.repeat(np.arange(len(found)), tables))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel()), *(some.column(i).take(take) for i in range(3)), marks.take(take)],
                        ["key", "node", "copies", "vec", "marks"])

    return map_batches(nodes.select("node", "copies", "vec"), task,
                       "key bigint, node bigint, copies bigint, vec binary, marks binary")


def _links(dealt: DataFrame, least: float) -> DataFrame:
    """For each group: links found per vector (node, null, links), and tree
    edges (node, other, 0). A pair counts only in the first table it shares,
    and there only in the group of its own pair of blocks."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, spans in sorted_groups(batches, ["key", "left", "right"]):
            key, node, copies, part, left, right = (
                rows.column(c).to_numpy() for c in ("key", "node", "copies", "part", "left", "right"))
            for start, end in spans:
                some = rows.slice(start, end - start)
                values = stacked(some.column("vec"))
                values = values / np.linalg.norm(values, axis=1, keepdims=True)
                links = values @ values.T >= least
                if left[start] != right[start]:
                    links &= part[start:end, None] != part[None, start:end]
                a, b = np.nonzero(np.triu(links, 1))
                number = int(key[start] >> 32) & 0xFF
                if len(a) and number:
                    marks = np.frombuffer(b"".join(some.column("marks").to_pylist()), dtype="<u4")
                    marks = marks.reshape(end - start, -1)[:, :number]
                    new = np.ones(len(a), dtype=bool)
                    for at in range(0, len(a), 50_000):
                        cut = slice(at, at + 50_000)
                        new[cut] = ~(marks[a[cut]] == marks[b[cut]]).any(axis=1)
                    a, b = a[new], b[new]
                if not len(a):
                    continue
                own, n = copies[start:end], end - start
                found = np.bincount(a, own[b], n) + np.bincount(b, own[a], n)
                links = np.zeros((n, n), dtype=bool)
                links[a, b] = links[b, a] = True
                edges = np.array(spanning(links))
                have = np.flatnonzero(found)
                nodes = node[start:end]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((nodes[have], nodes[edges[:, 0]]))),
                     pa.array([None] * len(have) + nodes[edges[:, 1]].tolist(), pa.int64()),
                     pa.array(np.concatenate((found[have].astype(np.int64), np.zeros(len(edges), dtype=np.int64))))],
                    ["node", "other", "links"])

    return map_batches(dealt, task, "node bigint, other bigint, links bigint")


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9,
                     tables: int = 32, bits: int = 14, name: str = "embed") -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Vectors are linked if their cosine, in double precision, is at least
    ``least`` and they share the signs of ``bits`` random hyperplanes in one of
    ``tables`` tables; vectors of different lengths never are. A pair at cosine
    0.9 is found with probability 0.98, at 0.95 with 0.9998. More vectors call
    for more bits and, to hold that, more tables.

    Equal vectors collapse to one node with a number of copies, large buckets
    are cut into blocks, and groups give counts and a spanning tree instead
    of their pairs. Null or zero vectors and those with null or non-finite
    components link with nothing and are their own component. Rows equal in id and
    vector are one row; an id with several vectors has a row for each. A row with
    a null id links with nothing, has no component and is not kept.
    """
    rows = pin(byte_vectors(df, id_col, vector_col, keep_zero=False), f"{name}-rows")
    nodes = rows.filter("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("smallest"), F.count("*").alias("copies"))
    nodes = pin(nodes.withColumn("node", F.monotonically_increasing_id()), f"{name}-nodes")
    dealt = in_blocks(_keyed(nodes, tables, bits), ["key"], "node", BLOCK, f"{name}-large")
    found = pin(_links(dealt, least), f"{name}-links")
    roots = connected_components(found.filter("other IS NOT NULL").select("node", "other"), f"{name}-components")
    counted = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    marked = (
        nodes.join(counted, "node", "left").join(roots, F.col("node") == F.col("id"), "left")
        .select("vec", "smallest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "node").alias("root"))
    )
    marked = pin(marked, f"{name}-marked")
    named = marked.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = pin(marked.join(named, "root").select("vec", "n_links", "component_id"), f"{name}-named")
    joined = rows.join(named, "vec", "left")
    own = F.coalesce("component_id", "id")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"),
                         F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def op3_embedding_dedup(spark, data_dir: str) -> DataFrame:
    """Links, component and keeper of every embedding at cosine 0.9."""
    return embedding_groups(table(spark, data_dir, "embeddings")).withColumnRenamed("id", "vec_id")
