"""Vectors as bytes: checked, compared by value."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import map_batches


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) of the rows of each length; rows that are
    null, empty or hold null or non-finite components are left out."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        values = flat[starts[rows][:, None] + np.arange(length)]
        fine = np.isfinite(values).all(axis=1)
        yield rows[fine], values[fine]


def stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Float64 matrix of byte vectors of one length."""
    items = column.to_pylist()
    return np.frombuffer(b"".join(items), dtype="<f8").reshape(len(items), -1) if items else np.empty((0, 0))


def byte_vectors(df: DataFrame, id_col: str, vector_col: str,
                 change: Callable[[np.ndarray], np.ndarray] = lambda x: x, keep_zero: bool = True) -> DataFrame:
    """(id, vec): the vector's float64 bytes after ``change``, null if it can't be used or
    has no id. Rows equal in id and vector are one; an id may have several vectors."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            for rows, values in matrices(batch.column(1)):
                values = np.ascontiguousarray(change(values) + 0.0, dtype="<f8")
                for row, value in zip(rows.tolist(), values):
                    if keep_zero or value.any():
                        out[row] = value.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    parsed = map_batches(rows, task, "id bigint, vec binary")
    return parsed.select("id", F.when(F.col("id").isNotNull(), F.col("vec")).alias("vec")).distinct()
