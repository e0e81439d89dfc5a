"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.sources.shared import pin

MAX_ROUNDS = 60


def _smallest(pairs: DataFrame) -> DataFrame:
    """Smallest ``v`` of each ``u``, under a key that Spark deals anew.

    The key is computed, so the join below shuffles both its sides itself and
    a hot vertex can be split by the adaptive skew join.
    """
    best = pairs.groupBy("u").agg(F.min("v").alias("best"))
    return best.select(F.expr("u ^ 0L").alias("key"), "best")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.filter("v > u").join(_smallest(both), F.col("u") == F.col("key"))
    return joined.select(F.col("v").alias("u"), F.least("best", F.col("u")).alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_smallest(down), F.col("u") == F.col("key"))
    moved = joined.filter("v != best").select(F.col("v").alias("u"), F.col("best").alias("v"))
    return moved.union(_smallest(down).select(F.col("key").alias("u"), F.col("best").alias("v")))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every vertex with an edge; component is the smallest id.

    ``edges`` has two bigint columns; direction, loops and repeats don't
    matter, null ends are left out. Large-star and small-star steps alternate
    until each vertex hangs on its root; the number of rounds grows with the
    logarithm of the graph. Each round is written to the shared folder, so
    the lineage stays short and a lost executor costs one round at most.
    An edge table without rows gives a result without rows.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    now = pin(now.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = _mark(now)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        now = pin(_small_star(_large_star(now).distinct()).distinct(), name)
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)),
                    F.coalesce(F.sum(F.shiftrightunsigned(h, 24)), F.lit(0))).first()
    return tuple(row)
