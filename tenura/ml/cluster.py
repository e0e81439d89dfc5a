"""K-Means segments and principal components over six scaled features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.ml.prep import fit_medians, fit_scales, impute, spread, standard_scale
from tenura.schema import CLUSTER_FEATURES, CUSTOMER_ID, RANDOM_SEED
from tenura.sources.shared import pin
from tenura.sources.workers import find_package, map_batches


SILHOUETTE_POINTS = 100_000  # distinct points of which all pairs are compared
SILHOUETTE_BLOCK = 1024
POINTS_AT_ONCE = 2048  # of a block, whose distances to all centers are held


def cluster_vectors(df: DataFrame, features: Sequence[str] = CLUSTER_FEATURES,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Median-filled, standardised feature vectors beside the kept columns."""
    named = df.select(*keep, *[F.col(c).cast("double").alias(f"_{c}") for c in features])
    names = [f"_{c}" for c in features]
    filled = impute(named, fit_medians(named, names))
    scaled = standard_scale(filled, fit_scales(filled, names))
    return VectorAssembler(inputCols=names, outputCol="features").transform(scaled).select(
        *keep, "features"
    )


@dataclass
class Clustering:
    """Centers of one fit, its cost and the passes over the rows it took."""

    centers: np.ndarray
    cost: float = 0.0
    passes: int = 0
    converged: bool = False

    def assign(self, vectors: DataFrame) -> DataFrame:
        """The rows with ``prediction``, the number of the nearest center (the lowest of ties)."""
        apart = [sum(((F.col("_v")[i] - F.lit(x)) ** 2 for i, x in enumerate(c)), F.lit(0.0)) for c in self.centers.tolist()]
        near = vectors.withColumn("_v", vector_to_array("features")).withColumn("_d", F.array(*apart))
        number = F.array_position("_d", F.array_min("_d")) - 1
        return near.withColumn("prediction", number.cast("int")).drop("_v", "_d")


def point_blocks(vectors: DataFrame) -> DataFrame:
    """(n, x): many rows' vectors as bytes of float64, one place of all rows after the other."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                values = batch.column(0).flatten().to_numpy().reshape(n, -1)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([values.T.tobytes()], pa.binary())], ["n", "x"])

    return map_batches(vectors.select(vector_to_array("features").alias("v")), task, "n int, x binary")


def nearest_sums(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows (and their number) that are nearest to each center, of shape (fits,
    centers, places + 1), and each fit's summed squared distances; of points of shape
    (places, rows) and centers of shape (fits, centers, places)."""
    fits, k, places = centers.shape
    # A squared distance is this and the point's squared length, which no choice depends on.
    far = ((centers ** 2).sum(axis=2)[:, :, None] - 2 * (centers.reshape(-1, places) @ points).reshape(fits, k, -1))
    least, at = far[:, 0].copy(), np.zeros((fits, points.shape[1]), dtype=np.int64)
    for j in range(1, k):
        at[far[:, j] < least] = j
        np.minimum(least, far[:, j], out=least)
    sums = np.empty((fits, k, places + 1))
    for fit in range(fits):
        for i in range(places):
            sums[fit, :, i] = np.bincount(at[fit], points[i], k)
        sums[fit, :, places] = np.bincount(at[fit], minlength=k)
    return sums, np.maximum(least + (points ** 2).sum(axis=0), 0).sum(axis=1)


def refine(blocks: DataFrame, fits: Sequence[Clustering], max_passes: int, tolerance: float) -> None:
    """Move the centers of all fits to the means of their rows until they rest, by one
    aggregation over all rows per step for all fits together. A center without rows
    stays. The cost is that of the centers before the last step."""
    places = fits[0].centers.shape[1]
    cells = [f"s{i}" for i in range(places + 1)]

    while going := [i for i, f in enumerate(fits) if not f.converged and f.passes < max_passes]:
        by_k: dict[int, list[int]] = {}
        for i in going:
            by_k.setdefault(len(fits[i].centers), []).append(i)
        told = [(numbers, np.stack([fits[i].centers for i in numbers])) for numbers in by_k.values()]

        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [[np.zeros((*c.shape[:2], places + 1)), np.zeros(len(c))] for _, c in told]
            for batch in batches:
                for n, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    points = np.frombuffer(x.as_buffer(), dtype="<f8").reshape(places, n)
                    for begin in range(0, n, POINTS_AT_ONCE):
                        some = np.ascontiguousarray(points[:, begin:begin + POINTS_AT_ONCE])
                        for total, (_, centers) in zip(held, told):
                            for old, more in zip(total, nearest_sums(some, centers)):
                                old += more
            for (numbers, centers), (sums, costs) in zip(told, held):
                k = centers.shape[1]
                fit, number = np.repeat(numbers, k), np.tile(np.arange(k), len(numbers))
                cost = np.zeros((len(numbers), k))
                cost[:, 0] = costs
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fit.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(cost.ravel()),
                     *(pa.array(sums[:, :, i].ravel()) for i in range(places + 1))], ["fit", "center", "cost", *cells])

        schema = ", ".join(["fit int, center int, cost double", *(f"{c} double" for c in cells)])
        found = map_batches(blocks, task, schema).groupBy("fit", "center").agg(
            *[F.sum(c).alias(c) for c in ("cost", *cells)]).collect()     # one per center
        for i in going:
            fits[i].cost, fits[i].converged = 0.0, True
            fits[i].passes += 1
        for r in found:
            fit, n = fits[r.fit], r[f"s{places}"]
            fit.cost += r.cost
            if n:
                moved = np.array(r[3:3 + places]) / n
                fit.converged &= bool(((moved - fit.centers[r.center]) ** 2).sum() <= tolerance ** 2)
                fit.centers[r.center] = moved


def best_kmeans(vectors: DataFrame, ks: Sequence[int], starts: int = 10, seed: int = RANDOM_SEED,
                parallelism: int = 4, max_passes: int = 300) -> list[Clustering]:
    """Per number of clusters the fit with the lowest cost out of several seeded starts.
    Spark's k-means gives the starts; all of them share the passes over the rows."""
    def start(at: tuple[int, int]) -> Clustering:
        k, i = at
        return Clustering(np.array(KMeans(k=k, seed=seed + i, maxIter=0).fit(vectors).clusterCenters()))

    wanted = [(k, i) for k in ks for i in range(starts)]
    with ThreadPool(min(parallelism, len(wanted))) as pool:
        fits = pool.map(start, wanted, chunksize=1)
    blocks = point_blocks(vectors).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        refine(blocks, fits, max_passes, KMeans().getTol())
    finally:
        blocks.unpersist()
    return [min(fits[i * starts:(i + 1) * starts], key=lambda f: f.cost) for i in range(len(ks))]


def kmeans_sweep(df: DataFrame, ks: Sequence[int] = range(2, 9), starts: int = 10,
                 features: Sequence[str] = CLUSTER_FEATURES, key: str = CUSTOMER_ID, euclidean: bool = False) -> DataFrame:
    """Inertia and silhouette per number of clusters. The silhouette is the
    squared-Euclidean one, which needs no distances between pairs of rows, or
    the ``euclidean`` one, for as many rows as ``euclidean_silhouette`` takes."""
    vectors = spread(pin(cluster_vectors(df, features, [key]), "cluster-vectors"), key).select("features").persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        silhouette = ClusteringEvaluator()
        rows = []
        for k, model in zip(ks, best_kmeans(vectors, ks, starts)):
            found = model.assign(vectors)
            shape = (euclidean_silhouette(found.withColumnRenamed("prediction", "cluster")) if euclidean
                     else float(silhouette.evaluate(found)))
            rows.append((k, float(model.cost), shape))
    finally:
        vectors.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def euclidean_silhouette(points: DataFrame, max_points: int = SILHOUETTE_POINTS) -> float | None:
    """Mean silhouette by Euclidean distance of (cluster, features), exactly.

    Equal points collapse first. Every block of distinct points meets every other in a
    task of its own, which adds up distances per point and cluster; so the work grows
    with the square of the distinct points, and more than ``max_points`` of them are
    refused. A point alone in its cluster counts 0; one cluster alone has none."""
    values = points.select(F.col("cluster").cast("int").alias("cluster"), vector_to_array("features").alias("v"))
    distinct = pin(values.groupBy("cluster", "v").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "point", F.monotonically_increasing_id()), "silhouette-points")
    sizes = {r.cluster: (r.n, r.points) for r in distinct.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("points")).collect()}     # one per cluster
    total = sum(p for _, p in sizes.values())
    if total > max_points:
        raise ValueError(f"{total} distinct points; {max_points} are the most whose pairs are compared")
    if len(sizes) < 2:
        return None
    find_package(points.sparkSession)
    blocks = -(-total // SILHOUETTE_BLOCK)
    clusters = sorted(sizes)
    own = distinct.withColumn("own", F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = own.withColumn("other", every)
    right = pin(own, "silhouette-right").withColumnRenamed("own", "other").withColumn("own", every)

    def apart(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (np.array(t.column("v").to_pylist()) for t in (a, b))
        if not (len(x) and len(y)):
            return pa.table({"point": pa.array([], pa.int64()), "sums": pa.array([], pa.list_(pa.float64()))})
        far = np.sqrt(np.maximum(((x[:, None] - y[None]) ** 2).sum(axis=2), 0)) * b.column("n").to_numpy()[None]
        of = b.column("cluster").to_numpy()
        sums = np.stack([far[:, of == c].sum(axis=1) for c in clusters], axis=1)
        return pa.table({"point": a.column("point"), "sums": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    parts = left.groupBy("own", "other").cogroup(right.groupBy("own", "other")).applyInArrow(
        apart, "point bigint, sums array<double>")
    sums = parts.groupBy("point").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(clusters))])
    joined = distinct.join(sums, "point")
    inside, outside = F.when(F.lit(False), 0.0), F
    for i, c in enumerate(clusters):
        n = sizes[c][0]
        inside = inside.when(F.col("cluster") == c, F.col(f"s{i}") / max(n - 1, 1))
        others = [F.col(f"s{j}") / sizes[d][0] for j, d in enumerate(clusters) if d != c]
        outside = outside.when(F.col("cluster") == c, F.least(*others) if len(others) > 1 else others[0])
    alone = F.col("cluster").isin([c for c in clusters if sizes[c][0] == 1])
    shape = F.when(alone, 0.0).otherwise(F.coalesce(
        F.try_divide(outside - inside, F.greatest(outside, inside)), F.lit(0.0)))
    return joined.agg((F.sum(shape * F.col("n")) / F.sum("n")).alias("s")).first().s


def kmeans_assign(df: DataFrame, k: int = 3, starts: int = 10,
                  features: Sequence[str] = CLUSTER_FEATURES, key: str = CUSTOMER_ID) -> DataFrame:
    """The table with Customer_Cluster, numbered by rising first feature."""
    vectors = cluster_vectors(df, features, df.columns)
    training = spread(pin(vectors.select(key, "features"), "cluster-vectors"), key).select("features").persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        model = best_kmeans(training, [k], starts)[0]
    finally:
        training.unpersist()
    order = sorted(range(len(model.centers)), key=lambda i: tuple(model.centers[i]))
    number = F.array_position(F.array(*[F.lit(i) for i in order]), F.col("prediction")) - 1
    return model.assign(vectors).select(
        *df.columns, number.cast("int").alias("Customer_Cluster")
    )


def fit_pca(vectors: DataFrame, components: int = 2):
    """(loadings, explained shares); the largest loading of each is positive."""
    model = PCA(k=components, inputCol="features", outputCol="pcs").fit(vectors)
    loadings = model.pc.toArray().T
    signed = [row * (1.0 if row[abs(row).argmax()] > 0 else -1.0) for row in loadings]
    return [[float(x) for x in row] for row in signed], [float(v) for v in model.explainedVariance]


def pca_project(df: DataFrame, components: int = 2, features: Sequence[str] = CLUSTER_FEATURES,
                key: str = CUSTOMER_ID) -> DataFrame:
    """Key and projections PCA1, PCA2, ... of every customer."""
    vectors = cluster_vectors(df, features, [key])
    loadings, _ = fit_pca(vectors.select("features"), components)
    values = vectors.select(key, vector_to_array("features").alias("v"))
    return values.select(key, *[
        sum((F.col("v")[j] * F.lit(w) for j, w in enumerate(row)), F.lit(0.0)).alias(f"PCA{i + 1}")
        for i, row in enumerate(loadings)
    ])


def pca_variance(df: DataFrame, components: int = 2, features: Sequence[str] = CLUSTER_FEATURES
                 ) -> DataFrame:
    """Explained and cumulative share of the variance per component."""
    _, shares = fit_pca(cluster_vectors(df, features), components)
    rows = df.sparkSession.createDataFrame(
        list(enumerate(shares, 1)), "component int, explained double"
    )
    up_to = Window.orderBy("component")     # one row per component
    return rows.withColumn("cumulative", F.sum("explained").over(up_to))
