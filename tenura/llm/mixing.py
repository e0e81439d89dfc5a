"""Mixing of sources to target weights by a temperature.

The weight of a source is its share of all tokens to the power of an exponent,
normalised. The exponent is bisected until the weights have a wanted entropy or
no source repeats more often than allowed. The mix is then realised as epochs:
each epoch of a source is a keyed permutation of its blocks and of the documents
in them, and the last one ends where the source's budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.common import table
from tenura.sources.shared import pin

BLOCK_DOCS, MAX_BLOCKS = 512, 1 << 16
POINTS, ROUNDS = 16, 9  # exponents tried at once; 17 ** -9 of the bracket is left
HIGHEST = 8.0  # exponents above 1 sharpen the shares
NO_SOURCE = "\0"


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def exponent_figures(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """(sum of weights before normalising, entropy, largest and smallest ratio of
    weight to share) at each exponent, in one pass over positive ``share``."""
    p = F.col("share")
    columns = []
    for t in exponents:
        power, ratio = F.pow(p, F.lit(t)), F.pow(p, F.lit(t - 1))
        columns += [F.sum(power), F.sum(power * F.log(p)), F.max(ratio), F.min(ratio)]
    row = shares.agg(*columns).first()
    out = []
    for i, t in enumerate(exponents):
        total, logs, high, low = row[4 * i:4 * i + 4]
        out.append((total, math.log(total) - t * logs / total, high, low))
    return out


def find_exponent(shares: DataFrame, entropy: float | None, max_repeats: float | None, budget_share: float | None) -> float:
    """The smallest exponent, so the most even mix, whose entropy is at most
    ``entropy`` and whose sources repeat at most ``max_repeats`` times. Repeats
    follow from the budget (as a share of all tokens), or, without one, from
    giving the least repeated source one epoch. Without a limit it is 1.

    Both figures fall with the exponent, so each pass over the shares cuts the
    bracket into ``POINTS`` + 1 parts. A limit out of reach gives the end of the
    bracket, 0 or ``HIGHEST`` (1 for repeats)."""
    def fits(figures: tuple[float, float, float, float], limit: str) -> bool:
        total, found, high, low = figures
        if limit == "entropy":
            return found <= entropy + 1e-12
        repeats = high / low if budget_share is None else budget_share * high / total
        return repeats <= max_repeats * (1 + 1e-12)

    limits = [("entropy", HIGHEST)] if entropy is not None else []
    limits += [("repeats", 1.0)] if max_repeats is not None else []
    best = 0.0 if limits else 1.0
    for limit, high in limits:
        low = 0.0
        if fits(exponent_figures(shares, [0.0])[0], limit):
            continue
        for _ in range(ROUNDS):
            tried = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
            good = [t for t, f in zip(tried, exponent_figures(shares, tried)) if fits(f, limit)]
            below = [t for t in tried if not good or t < good[0]]
            low, high = max([low, *below]), good[0] if good else high
        best = max(best, high)
    return best


def _parts(rows: DataFrame, id_col: str, seed: int, epoch: Column) -> DataFrame:
    """Adds the block of each row, and its keys in the permutations of ``epoch``."""
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.col("__blocks"))
    rows = rows.withColumn("__block", block)
    return rows.withColumns({
        "__outer": F.xxhash64(F.lit(seed), epoch, F.col("__source"), F.col("__block")),
        "__inner": F.xxhash64(F.lit(seed + 1), epoch, F.col(id_col)),
    })


def mixing_plan(counted: DataFrame, entropy: float | None = None, max_repeats: float | None = None,
                budget: int | None = None, seed: int = 7, name: str = "mixing") -> DataFrame:
    """A row per source of ``counted`` (__source, __id, __tokens): documents, tokens,
    share, weight, repeats, whole epochs, and where the last epoch ends (the keys
    of the last block and of the last document in it).

    The budget is a number of tokens; without one it is the smallest that gives
    every document once. The last epoch never exceeds its source's budget."""
    sources = counted.groupBy("__source").agg(F.count("*").alias("docs"), F.sum("__tokens").alias("tokens"))
    sources = pin(sources, f"{name}-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(max(total, 1))
    shares = sources.filter("tokens > 0").select(share.alias("share"))
    exponent, scale = 1.0, 1.0
    if total:
        budget_share = None if budget is None else budget / total
        exponent = find_exponent(shares, entropy, max_repeats, budget_share)
        norm, _, _, low = exponent_figures(shares, [exponent])[0]
        scale = 1 / low if budget is None else budget_share / norm
    else:
        norm = 1.0
    repeats = F.when(F.col("tokens") > 0, scale * F.pow("share", F.lit(exponent - 1))).otherwise(1.0)
    blocks = F.least(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(MAX_BLOCKS)).cast("bigint")
    # The repeats of the source with the most tokens are 1 up to rounding.
    near = F.round("repeats", 9)
    plan = (
        sources.withColumn("share", share)
        .withColumn("weight", F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent)) / norm).otherwise(0.0))
        .withColumn("repeats", repeats).withColumn("repeats", near)
        .withColumn("epochs", F.floor("repeats").cast("int")).withColumn("__blocks", blocks)
        .withColumn("left", F.floor((F.col("repeats") - F.col("epochs")) * F.col("tokens")).cast("bigint"))
        .withColumn("exponent", F.lit(exponent))
    )
    plan = pin(plan, f"{name}-plan")
    partial = plan.filter("left > 0").select("__source", "__blocks", "epochs", "left")
    keyed = _parts(counted.join(partial, "__source"), "__id", seed, F.col("epochs"))
    sums = pin(keyed.groupBy("__source", "__outer").agg(F.sum("__tokens").alias("n"), F.first("left").alias("left")), f"{name}-blocks")
    upto = F.sum("n").over(Window.partitionBy("__source").orderBy("__outer"))
    # The first block that doesn't fit as a whole holds the end.
    ends = (
        sums.withColumn("upto", upto).filter("upto > left").groupBy("__source")
        .agg(F.min_by(F.struct("__outer", (F.col("left") - F.col("upto") + F.col("n")).alias("rest")), "upto").alias("end"))
        .select("__source", F.col("end.__outer").alias("end_block"), F.col("end.rest").alias("rest"))
    )
    ends = pin(ends, f"{name}-ends")
    last = keyed.join(ends.withColumnRenamed("__source", "__s"), (F.col("__source") == F.col("__s")) & (F.col("__outer") == F.col("end_block")))
    inner = Window.partitionBy("__source").orderBy("__inner").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = last.withColumn("upto", F.sum("__tokens").over(inner)).filter("upto <= rest")
    taken = taken.groupBy("__source").agg(F.max("__inner").alias("end_doc"))
    out = plan.join(ends.drop("rest"), "__source", "left").join(taken, "__source", "left")
    return pin(out, f"{name}-ready")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None,
        entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None,
        seed: int = 7, name: str = "mixing") -> DataFrame:
    """The rows of the mix: all columns of ``docs``, with ``epoch`` (from 0) and
    ``position`` (0 to 1), by which rows are ordered so that every source advances
    evenly. A column of such a name in ``docs`` is replaced.

    ``tokens`` counts the tokens of a row (default: words of ``text``). Rows with a
    null source are a source of their own. Documents without tokens come along
    in whole epochs, and once if their whole source has none. Rows that share an
    id stay together. Only one row per source travels; with few sources the
    documents aren't shuffled."""
    keep = [c for c in docs.columns if c not in ("epoch", "position")]
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    counted = docs.select(source.alias("__source"), F.col(id_col).alias("__id"),
                          (word_count(F.col("text")) if tokens is None else tokens).alias("__tokens"))
    plan = mixing_plan(pin(counted, f"{name}-counted"), entropy, max_repeats, budget, seed, name)
    plan = plan.select("__source", "__blocks", "repeats", "epochs", "left", "end_block", "end_doc")
    # The columns of a document travel as one, so that none clashes with the plan's.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__doc"), F.col(id_col).alias("__id"),
                       source.alias("__source")).join(plan, "__source")
    each = F.explode(F.sequence(F.lit(0), F.col("epochs")))
    rows = _parts(rows.withColumn("__epoch", each), "__id", seed, F.col("__epoch"))
    before = F.coalesce(F.col("__outer") < F.col("end_block"), F.col("left") > 0)
    inside = (F.col("__outer") == F.col("end_block")) & (F.col("__inner") <= F.col("end_doc"))
    part = (F.col("__epoch") < F.col("epochs")) | ((F.col("left") > 0) & (before | F.coalesce(inside, F.lit(False))))
    unit = (F.col("__outer") / 2.0**64 + 0.5) + F.col("__inner") / 2.0**64 / F.col("__blocks")
    position = F.least(F.greatest((F.col("__epoch") + unit) / F.greatest("repeats", F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    return rows.filter(part).select("__doc.*", F.col("__epoch").alias("epoch"), position.alias("position"))


def op10_source_mix(spark, data_dir: str) -> DataFrame:
    """The mix of all documents by source in which none repeats more than twice
    while every document comes at least once."""
    docs = table(spark, data_dir, "documents")
    found = mix(docs, max_repeats=2.0)
    return found.select("doc_id", "source", "epoch", "position")
