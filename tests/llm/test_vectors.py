import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.llm.embed_dedup import embedding_groups, op3_embedding_dedup
from tenura.llm.knn import best_of_block, op2_exact_top_k, top_k
from tenura.llm.queries import build_oracles

from ..conftest import DATA
from .test_simhash import roots

SCHEMA = "vec_id bigint, embedding array<float>"
NAN, INF = float("nan"), float("inf")


def odd_rows(n=120, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 8)).round(3)
    base[10:40] = base[9] + rng.standard_normal((30, 8)) * 0.02
    base[50:60] = base[49]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    bad = [None, [], [1.0] * 7 + [None], [NAN] * 8, [INF] + [0.0] * 7]
    rows += [(200 + i, v) for i, v in enumerate(bad)]
    return rows + [(300, [0.0] * 8), (350, [1.0, 2.0]), (351, [1.0, 2.1])]


def fine(rows):
    return {i: np.float32(v).astype(float) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all()}


def brute_top(rows, k=5):
    vectors = {i: np.floor(256 * v).astype(int) for i, v in fine(rows).items()}
    out = []
    for q in (i for i in vectors if i % 50 == 0):
        scores = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def brute_groups(rows, least=0.9):
    ids = [i for i, _ in rows]
    vectors = {i: v for i, v in fine(rows).items() if v.any()}
    edges = [(a, b) for a in vectors for b in vectors if a < b and len(vectors[a]) == len(vectors[b])
             and vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b]) >= least]
    found = roots(ids, edges)
    links = {i: sum(i in e for e in edges) for i in ids}
    return {i: (links[i], found[i], i == found[i]) for i in ids}


def test_top_k_of_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", score int")
    got = sorted(map(tuple, top_k(df, F.col("id") % 50 == 0).collect()))
    assert got == brute_top(rows)


def test_top_k_in_small_blocks(spark, monkeypatch):
    import tenura.llm.knn as module
    for name, value in (("PIVOTS", 4), ("DATA_BLOCK", 7), ("QUERY_BLOCK", 2)):
        monkeypatch.setattr(module, name, value)
    rows = odd_rows(seed=4)
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0).collect()))
    assert got == brute_top(rows)


def test_top_k_equals_sql(spark, duck):
    got = sorted(map(tuple, op2_exact_top_k(spark, DATA).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(duck.execute(build_oracles()["op2_exact_top_k"]).fetchall())


def test_block_takes_ties_by_id_and_large_numbers():
    ids = np.array([4, 2, 9])
    data = np.array([[1.0, 0], [1, 0], [1, 1]])
    found = best_of_block(np.array([[2.0, 0]]), np.array([9]), data, ids, 2)
    assert [x.tolist() for x in found] == [[9, 9], [2, 4], [2, 2]]
    big = np.array([[2.0**27 + 1] * 2])
    assert best_of_block(big, np.array([1]), big, np.array([3]), 1)[2].tolist() == [2 * (2**27 + 1) ** 2]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_k(df, F.col("id") % 50 == 0).collect() == [] and embedding_groups(df).collect() == []


def test_embedding_groups_of_odd_rows(spark):
    rows = odd_rows() + [(3, odd_rows()[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(None, [1.0] * 8, 2)], SCHEMA + ", kept int")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embedding_groups(df, tables=40, bits=6).collect()}
    assert got.pop(None) == (0, None, False)
    assert got == brute_groups(odd_rows())


def test_embedding_groups_in_blocks(spark, monkeypatch):
    import tenura.llm.embed_dedup as module
    monkeypatch.setattr(module, "BLOCK", 4)
    rows = odd_rows(seed=8)
    got = {r.id: (r.n_links, r.component_id, r.kept)
           for r in embedding_groups(spark.createDataFrame(rows, SCHEMA), tables=40, bits=6).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_embedding_recall(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    # The table's vectors and two thirds as many noisy copies near the limit.
    rng = np.random.default_rng(1)
    for i, v in rows[:300]:
        noise = rng.standard_normal(64)
        noise *= np.linalg.norm(v) / np.linalg.norm(noise) * 0.45
        rows.append((i + 10_000, (np.array(v) + noise).tolist()))
    expected = brute_groups(rows)
    got = {r.id: r.n_links for r in embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] <= expected[i][0] for i in got)
    assert sum(got.values()) >= 0.95 * sum(e[0] for e in expected.values()) > 0


def test_embedding_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op3_embedding_dedup(spark, DATA).collect()}
    assert got == brute_groups(rows)


def test_repeated_ids_of_different_vectors(spark):
    """Every row of an id asks, is found and has its links; equal rows are one."""
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (50, [1.0, 0.1]), (50, [0.1, 1.0]), (50, [0.1, 1.0]), (3, [0.9, 0.1]), (9, None), (9, [1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in top_k(df, F.col("id") % 50 == 0, k=3).collect())
    expected, distinct = [], list({(i, tuple(v)): (i, v) for i, v in rows if v}.values())
    for at, (i, q) in enumerate(distinct):
        if i % 50 == 0:
            others = [(-sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(q, v)), j)
                      for n, (j, v) in enumerate(distinct) if n != at]
            expected += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(others)[:3], 1)]
    assert got == sorted(expected) and (50, 50) in {(q, v) for q, _, v, _ in got}
    groups = sorted((r.id, r.n_links, r.component_id, r.kept) for r in embedding_groups(df, tables=40, bits=4).collect())
    assert groups == [(3, 2, 3, True), (7, 1, 7, True), (7, 2, 3, False), (9, 0, 9, True), (9, 0, 9, True), (50, 1, 7, False), (50, 2, 3, False)]
