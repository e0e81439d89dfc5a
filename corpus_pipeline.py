"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes every stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm import mixing, near, packing, pseudonyms, quality
from tenura.llm.common import table
from tenura.sources.shared import pin

SHINGLE_WORDS, SIMILARITY = 5, 0.8
MAX_REPEATS = 2.0
PSEUDONYM_KEY = "corpus-2024"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from the labels, doesn't reject."""
    labels = quality.training_labels(table(spark, sf_dir, "labels"))
    model = quality.learn(docs, labels)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return quality.score(whole, model, ["doc"]).filter("predicted = 1").select("doc.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are alike by 0.8 and more, linked over
    others too, the one with the smallest doc_id (of several texts under it the one
    with the smallest hash); of rows equal in doc_id and text one. Different texts
    under one doc_id in different groups all stay. Rows without doc_id can't be told
    apart and stay."""
    groups = near.near_members(docs, words=SHINGLE_WORDS, similarity=SIMILARITY)
    best = groups.filter("id IS NOT NULL").groupBy("root").agg(F.min(F.struct("id", "mark")).alias("best"))
    kept = best.select(F.col("best.id").alias("__id"), F.col("best.mark").alias("__mark"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                        F.col("doc_id").cast("bigint").alias("__id"), near.text_mark("text").alias("__mark"))
    named = whole.filter("__id IS NOT NULL").join(kept, ["__id", "__mark"], "left_semi").dropDuplicates(["__id", "__mark"])
    return named.select("doc.*").union(docs.filter("doc_id IS NULL"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values become pseudonyms of their format; n_chars follows the text."""
    changed = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)
    return changed.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The most even mix of sources that gives every document once and none more
    than twice, in the order of the mix."""
    return mixing.mix(docs, max_repeats=MAX_REPEATS).orderBy("position").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.packed_digest(docs)


STAGES = [
    ("quality", keep_good),
    ("simhash_dedup", keep_one_of_each_group),
    ("pseudonyms", replace_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The quality model, the near-duplicate groups and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
