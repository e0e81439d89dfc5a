"""Model inputs: feature frame, imputation, scaling, encoding, exact splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Params
from pyspark.ml.util import (
    DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.operators.percentiles import exact_percentiles
from tenura.schema import CUSTOMER_ID, ML_EXCLUDED, RANDOM_SEED, TARGET_FLAG


SPREAD, SPREAD_ROWS = 8, 250_000  # partitions at least, and rows in one of more


def ml_feature_frame(df: DataFrame, excluded: Sequence[str] = ML_EXCLUDED, key: str = CUSTOMER_ID,
                     label: str = TARGET_FLAG) -> DataFrame:
    """Key, label and the columns a model may use; nothing that leaks the label."""
    return df.select(key, label, *[c for c in df.columns if c not in excluded])


def feature_types(df: DataFrame, key: str = CUSTOMER_ID, label: str = TARGET_FLAG
                  ) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns by type."""
    fields = [f for f in df.schema if f.name not in (key, label)]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in fields if isinstance(f.dataType, T.StringType)]


# --- fitted constants: one figure per column reaches the driver ---------------

def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    rows = exact_percentiles(df, columns, [0.5], names=["median"]).collect()
    return {r["metric"]: r["median"] for r in rows}


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per text column, the smallest of ties."""
    counts = df.select(*columns).unpivot([], list(columns), "column", "value").dropna(
        subset="value"
    ).groupBy("column", "value").count()
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("count")).alias("minus"), "value")).alias("best")
    )
    return {r["column"]: r["best"]["value"] for r in best.collect()}


def fit_scales(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) per column; a constant column is
    divided by one."""
    row = df.agg(*[
        F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in columns
    ]).first()
    return {c: (row[c][0] or 0.0, row[c][1] or 1.0) for c in columns}


def impute(df: DataFrame, values: Mapping) -> DataFrame:
    """Fill nulls with fitted constants. Numbers become doubles first, so that
    a median between two integers is not cut off."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double") if isinstance(v, float) else F.col(c), F.lit(v))
        for c, v in values.items()
    })


def standard_scale(df: DataFrame, scales: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in scales.items()
    })


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Layout for passes that repeat over the data: dealt by key and sorted, so
    that sampling by partition gives the same on any number of cores. The number
    of partitions follows the number of rows unless it is given, so that a model does
    not depend on the session's settings."""
    partitions = partitions or max(SPREAD, -(-df.count() // SPREAD_ROWS))
    return df.repartition(partitions, key).sortWithinPartitions(key)


def one_hot(columns: Sequence[str]) -> list:
    """Pipeline stages encoding each text column; a value not seen in fitting
    (or null) gives an all-zero vector."""
    indexed = [f"{c}_index" for c in columns]
    return [
        StringIndexer(inputCols=list(columns), outputCols=indexed, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_onehot" for c in columns],
                      dropLast=True),
    ]


class _Written(MLWriter):
    """Metadata with a JSON part, and the encoder beside it."""

    def __init__(self, stage: Params, more: dict, encoder: PipelineModel | None = None):
        super().__init__()
        self.stage, self.more, self.encoder = stage, more, encoder

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"fitted": self.more})
        if self.encoder is not None:
            self.encoder.write().save(f"{path}/encoder")


class _Read(MLReader):
    def __init__(self, stage: type):
        super().__init__()
        self.stage = stage

    def load(self, path: str) -> Preprocessor | PreprocessorModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.stage(**found["fitted"])
        stage._resetUid(found["uid"])
        if self.stage is PreprocessorModel:
            stage.encoder = PipelineModel.load(f"{path}/encoder")
        return stage


class Preprocessor(Estimator, MLWritable, MLReadable):
    """Median imputation and scaling for numbers, mode imputation and one-hot
    encoding for text, all fitted on the training rows only."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str]):
        super().__init__()
        self.numeric, self.categorical = list(numeric), list(categorical)

    def write(self) -> MLWriter:
        return _Written(self, {"numeric": self.numeric, "categorical": self.categorical})

    @classmethod
    def read(cls) -> MLReader:
        return _Read(cls)

    def _fit(self, df: DataFrame) -> PreprocessorModel:
        numeric, categorical = self.numeric, self.categorical
        medians, modes = fit_medians(df, numeric), fit_modes(df, categorical)
        filled = impute(impute(df, medians), modes)
        scales = fit_scales(filled, numeric)
        scaled_names = [f"{c}_scaled" for c in numeric]
        stages = Pipeline(stages=[
            *one_hot(categorical),
            VectorAssembler(
                inputCols=scaled_names + [f"{c}_onehot" for c in categorical],
                outputCol="features",
            ),
        ])
        model = PreprocessorModel(numeric, medians, modes, scales)
        model.encoder = stages.fit(model.scaled(df))
        return model


class PreprocessorModel(Model, MLWritable, MLReadable):
    """The fitted constants and encoder; can be written and read like Spark's own
    models, alone or as a stage of a pipeline."""

    def __init__(self, numeric=(), medians=None, modes=None, scales=None):
        super().__init__()
        self.numeric, self.medians, self.modes = list(numeric), medians, modes
        self.scales, self.encoder = scales, None

    def write(self) -> MLWriter:
        return _Written(self, {"numeric": self.numeric, "medians": self.medians, "modes": self.modes,
                               "scales": self.scales}, self.encoder)

    @classmethod
    def read(cls) -> MLReader:
        return _Read(cls)

    def feature_names(self) -> list[str]:
        """What each place of ``features`` holds: numbers by column, then column=label."""
        indexer = self.encoder.stages[0]
        labels = zip(indexer.getInputCols(), indexer.labelsArray)
        return [*self.numeric, *[f"{c}={v}" for c, values in labels for v in values]]

    def scaled(self, df: DataFrame) -> DataFrame:
        filled = impute(impute(df, self.medians), self.modes)
        copies = filled.withColumns({f"{c}_scaled": F.col(c) for c in self.numeric})
        return standard_scale(copies, {f"{c}_scaled": self.scales[c] for c in self.numeric})

    def _transform(self, df: DataFrame) -> DataFrame:
        encoded = self.encoder.transform(self.scaled(df))
        return encoded.select(*df.columns, "features")


# --- exact, seeded, stratified assignment -------------------------------------

def hash_key(key: str, seed: int) -> Column:
    """60 bits of the digest of seed and key, which any engine can tell."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def stratified_cuts(df: DataFrame, fractions: Sequence[float], strata: str, key: str, seed: int
                    ) -> DataFrame:
    """Per stratum, the (hash, key) pairs that end each cumulative fraction.

    The hash order is never materialised: 65,536 equal slices of the hash range
    are counted, and only the slices a cut falls into are sorted. The result
    has one row per stratum.
    """
    hashed = df.where(F.col(strata).isNotNull()).select(
        strata, key, hash_key(key, seed).alias("h")
    ).withColumn("slice", F.shiftright("h", 44))
    sizes = hashed.groupBy(strata, "slice").agg(F.count(F.lit(1)).alias("n"))
    in_stratum = Window.partitionBy(strata)
    up_to = in_stratum.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumns({
        "through": F.sum("n").over(up_to), "n_all": F.sum("n").over(in_stratum),
    })
    wanted = F.array(*[F.round(F.col("n_all") * F.lit(f)).cast("bigint") for f in fractions])
    targets = sizes.select(
        F.col(strata).alias("_s"), F.col("slice").alias("_slice"),
        (F.col("through") - F.col("n")).alias("before"), "through",
        F.explode(wanted).alias("target"),
    ).where((F.col("target") > F.col("before")) & (F.col("target") <= F.col("through")))
    # At most one slice per stratum and cut.
    marked = hashed.join(
        F.broadcast(targets.select("_s", "_slice").distinct()),
        (hashed[strata] == F.col("_s")) & (hashed["slice"] == F.col("_slice")), "left_semi",
    )
    in_slice = Window.partitionBy(strata, "slice").orderBy("h", key)
    ordered = marked.withColumn("position", F.row_number().over(in_slice))
    ends = ordered.join(
        F.broadcast(targets),
        (F.col(strata) == F.col("_s")) & (F.col("slice") == F.col("_slice"))
        & (F.col("position") == F.col("target") - F.col("before")),
    )
    return ends.groupBy(strata).agg(
        F.sort_array(F.collect_list(F.struct("h", F.col(key).alias("k")))).alias("cuts")
    )


def assign_parts(df: DataFrame, fractions: Sequence[float], out: str, strata: str = TARGET_FLAG,
                 key: str = CUSTOMER_ID, seed: int = RANDOM_SEED) -> DataFrame:
    """Number the rows 0..k by the cumulative fractions, exactly per stratum
    (to the row). The cuts are a few rows; numbering is a narrow projection.

    A fraction that rounds to no row of a stratum is passed by all its rows, so
    every row gets a number; rows without stratum get the last one."""
    rows = stratified_cuts(df, fractions, strata, key, seed).collect()
    here = F.struct(hash_key(key, seed).alias("h"), F.col(key).alias("k"))
    part = F.when(F.lit(False), F.lit(0))
    for r in rows:
        passed = sum((
            (here > F.struct(F.lit(c["h"]).cast("bigint").alias("h"), F.lit(c["k"]).alias("k"))).cast("int")
            for c in r["cuts"]
        ), F.lit(len(fractions) - len(r["cuts"])))
        part = part.when(F.col(strata) == r[strata], passed)
    return df.withColumn(out, part.otherwise(F.lit(len(fractions))).cast("int"))


def stratified_split(df: DataFrame, test_size: float = 0.2, strata: str = TARGET_FLAG,
                     key: str = CUSTOMER_ID, seed: int = RANDOM_SEED
                     ) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exact class proportions."""
    parts = assign_parts(df, [test_size], "_part", strata, key, seed)
    return (parts.where("_part = 1").drop("_part"), parts.where("_part = 0").drop("_part"))


def stratified_folds(df: DataFrame, folds: int = 5, strata: str = TARGET_FLAG,
                     key: str = CUSTOMER_ID, seed: int = RANDOM_SEED) -> DataFrame:
    cuts = [i / folds for i in range(1, folds)]
    return assign_parts(df, cuts, "fold", strata, key, seed)
