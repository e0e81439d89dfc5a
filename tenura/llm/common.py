"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.sources.shared import pin


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def crc_slice(column: str | Column, parts: int) -> Column:
    """crc32 of the value written as text, modulo ``parts``; null for null."""
    value = F.col(column) if isinstance(column, str) else column
    return (F.crc32(value.cast("string").cast("binary")) % parts).cast("int")


def byte_items(column: pa.Array) -> Iterator[bytes | None]:
    """The binary values of an Arrow array, one at a time."""
    for value in column:
        yield value.as_py()


def find_package(spark: SparkSession) -> None:
    """Name this package's folder to the Python workers, wherever they start.
    On a cluster the package is installed or shipped with ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


_remembered: dict[str, tuple[tuple, object]] = {}


def remembered(owner: str, key: tuple, build: Callable[[], object]) -> object:
    """What ``build`` gives, kept for the next tasks of this Python worker. A worker
    serves many stages: what another owner kept is let go."""
    let_go(owner)
    if owner not in _remembered or _remembered[owner][0] != key:
        _remembered[owner] = key, build()
    return _remembered[owner][1]


def let_go(owner: str) -> None:
    for other in [o for o in _remembered if o != owner]:
        del _remembered[other]


def map_batches(df: DataFrame, task: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    find_package(df.sparkSession)
    owner = task.__module__

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(owner)  # by name, so that it is the worker's own memory
        yield from task(batches)

    return df.mapInArrow(run, schema)


def with_text(df: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, int, str]:
    """The ``keep`` columns and the text, once; the place of the text; and the
    schema of the ``keep`` columns."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    if text_col in keep:
        return df.select(*keep), keep.index(text_col), ", ".join(kept)
    return df.select(*keep, F.col(text_col).alias("__text")), len(keep), ", ".join(kept)


def in_blocks(keyed: DataFrame, keys: list[str], item: str, block: int, name: str) -> DataFrame:
    """Deal the rows of every bucket to tasks of bounded size, losing no pair.

    A bucket (equal ``keys``) with more than ``block`` rows is cut into blocks
    by a hash of ``item``, and each pair of blocks becomes one group, so no
    group exceeds about two blocks. Adds ``left``, ``right`` (the pair of
    blocks) and ``part`` (the row's own block), deals rows by group and sorts
    them in each task. Smaller buckets stay one group (0, 0).

    The list of large buckets is written first; Spark broadcasts it only if
    that table is below its own broadcast limit.
    """
    large = pin(keyed.groupBy(*keys).count().filter(F.col("count") > block), name)
    blocks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    dealt = (
        keyed.join(large, keys, "left").withColumn("blocks", blocks)
        .withColumn("part", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other"))
        .drop("count", "blocks", "other")
    )
    group = [*keys, "left", "right"]
    return dealt.repartition(*group).sortWithinPartitions(*group)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups from batches sorted by ``keys``, each with the
    (start, end) of its groups of two rows and more. Only the rows of an open
    group are carried from one batch to the next."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if held is not None:
            now = pa.concat_tables([held, now]).combine_chunks()
        if not now.num_rows:
            continue
        starts = _starts(now, keys)
        cut = int(starts[-1])
        held = now.slice(cut)
        if cut:
            yield now.slice(0, cut), _spans(starts, cut)
    if held is not None and held.num_rows:
        yield held, _spans(np.array([0]), held.num_rows)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(rows.num_rows, dtype=bool)
    changed[0] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def _spans(starts: np.ndarray, end: int) -> list[tuple[int, int]]:
    starts = starts[starts < end]
    ends = np.append(starts[1:], end)
    wide = ends - starts > 1
    return list(zip(starts[wide].tolist(), ends[wide].tolist()))


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Tree edges (member, root) with the components of a boolean link matrix."""
    n = len(links)
    label = np.full(n, -1)
    edges = []
    for root in np.flatnonzero(links.any(axis=1)).tolist():
        if label[root] >= 0:
            continue
        label[root] = root
        front = np.array([root])
        while len(front):
            reached = np.flatnonzero(links[front].any(axis=0) & (label < 0))
            label[reached] = root
            edges += [(int(x), root) for x in reached]
            front = reached
    return edges
