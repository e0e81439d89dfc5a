"""Python tasks: where their workers find this package."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def find_package(spark: SparkSession) -> None:
    """Name this package's folder to the Python workers, wherever they start.
    On a cluster the package is installed or shipped with ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def map_batches(df: DataFrame, task: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    find_package(df.sparkSession)
    return df.mapInArrow(task, schema)
