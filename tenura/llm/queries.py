"""The queries of the corpus operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenura.llm.alignment import op11_token_alignment
from tenura.llm.embed_dedup import op3_embedding_dedup
from tenura.llm.fixity import OP9_SQL, op9_warc_fixity
from tenura.llm.html_text import op4_html_text
from tenura.llm.knn import op2_exact_top_k
from tenura.llm.language import op5_language_id
from tenura.llm.licences import op12_licence_scan
from tenura.llm.mixing import op10_source_mix
from tenura.llm.negatives import OP13_SQL, op13_hard_negatives
from tenura.llm.packing import op8_packing
from tenura.llm.pseudonyms import op7_pseudonyms
from tenura.llm.quality import op6_quality
from tenura.llm.simhash import op1_simhash_dedup

Query = Callable[[SparkSession, str], DataFrame]

QUERIES = [
    op1_simhash_dedup, op2_exact_top_k, op3_embedding_dedup, op4_html_text, op5_language_id,
    op6_quality, op7_pseudonyms, op8_packing, op9_warc_fixity, op10_source_mix,
    op11_token_alignment, op12_licence_scan, op13_hard_negatives,
]


def build_queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def build_oracles() -> dict[str, str]:
    return {"op2_exact_top_k": OP2_SQL, "op9_warc_fixity": OP9_SQL, "op13_hard_negatives": OP13_SQL}


# Meant for small tables: it scores all pairs of a query and a row. The sums
# are exact in either engine.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS g
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.g, d.g) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.g) = len(d.g)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank"
  FROM scored
)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5
"""
