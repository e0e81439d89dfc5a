"""The tables one analysis session works on.

The subscriber table and its cleaned form are written once to the shared
folder. Row features are a narrow projection over the cleaned table, so a
report reads only the base columns behind the features it uses.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tenura.ml import models
from tenura.operators.features import quantile_edges
from tenura.operators.quality import has_unique_ids
from tenura.plans.pipelines import clean_pipeline, feature_pipeline, row_features
from tenura.sources.shared import pin
from tenura.sources.subscribers import subscribers, with_dirt


class Workspace:
    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark, self.data_dir = spark, data_dir
        self._predictions: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.data_dir}/{name}.parquet")

    @cached_property
    def subscribers(self) -> DataFrame:
        return pin(subscribers(self.table("customer"), self.table("orders")), "subscribers")

    @property
    def raw(self) -> DataFrame:
        """A raw delivery: padded text, blank totals, repeated rows."""
        return with_dirt(self.subscribers)

    @cached_property
    def clean(self) -> DataFrame:
        return pin(clean_pipeline(self.raw), "clean")

    @cached_property
    def value_edges(self) -> list[float]:
        return quantile_edges(row_features(self.clean), "Estimated_LTV", 4)

    @property
    def features(self) -> DataFrame:
        return feature_pipeline(self.clean, self.value_edges)

    @cached_property
    def unique_ids(self) -> bool:
        """Checked once; lets reports count customers without shuffling keys."""
        return has_unique_ids(self.clean)

    def predictions(self, name: str) -> DataFrame:
        """Held-out predictions of a model, fitted on first use."""
        if name not in self._predictions:
            self._predictions[name] = pin(
                models.train_and_predict(self.features, name), f"predictions-{name}"
            )
        return self._predictions[name]


INPUTS = ("customer", "orders")
_open: dict[tuple[str, str], tuple[tuple, Workspace]] = {}


def _state(spark: SparkSession, data_dir: str) -> tuple:
    """Time and size of the input tables, from the file system that Spark reads."""
    found = []
    for name in INPUTS:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{data_dir}/{name}.parquet")
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found.append((files.getFileStatus(place).getModificationTime(), files.getContentSummary(place).getLength()))
    return tuple(found)


def workspace(spark: SparkSession, data_dir: str) -> Workspace:
    """The workspace of a folder, opened anew when its input tables change."""
    key = (spark.sparkContext.applicationId, str(data_dir).rstrip("/"))
    state = _state(spark, key[1])
    if key not in _open or _open[key][0] != state:
        _open[key] = state, Workspace(spark, key[1])
    return _open[key][1]
