import random
import re

import numpy as np
import pytest
import xxhash

from tenura.llm.components import connected_components
from tenura.llm.golay import nearest, tables
from tenura.llm.simhash import Print, fingerprint, op1_simhash_dedup, shingle_hashes, simhash_groups

from ..conftest import DATA

SCHEMA = "doc_id bigint, text string"


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    """Expected (fingerprint, component) of (id, text) rows with distinct ids."""
    prints = {i: plain_fingerprint(t) for i, t in rows}
    ids = list(prints)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (prints[a] ^ prints[b]).bit_count() <= 3]
    found = roots(ids, edges)
    return {i: (format(prints[i], "016x"), found[i]) for i in ids}


def test_golay_neighbours_share_a_codeword():
    _, _, count = tables()
    assert np.bincount(count).tolist() == [0, 2325, 0, 0, 0, 0, 1771]
    words = np.random.default_rng(1).integers(0, 1 << 24, 3000)
    keys, _ = nearest(words)
    for bit in range(24):
        other, _ = nearest(words ^ (1 << bit))
        assert (keys[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()


def test_fingerprint_of_many_shingles():
    text = " ".join(f"w{i % 700}" for i in range(5000))
    assert fingerprint(shingle_hashes(text.encode(), 3))[0] == plain_fingerprint(text)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash_dedup(spark, DATA).collect()}
    assert got == brute(rows)


def test_edges(spark):
    long = "Long words " * 40_000
    rows = [(5, "a b c"), (3, "A  b\tC"), (9, None), (8, ""), (7, " \n"), (4, "é È ü x"), (6, "é È ü x"), (2, long), (1, "one")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", component_id string, fingerprint int")
    got = {r.id: (r.fingerprint, r.component_id) for r in simhash_groups(df).collect()}
    assert got == brute(rows) and got[9] == ("0" * 16, 7)
    same = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "alone here")], SCHEMA)
    assert sorted(map(tuple, simhash_groups(same).select("id", "component_id").collect()), key=str) == [
        (1, 1), (1, 1), (None, 1), (None, None)]
    assert simhash_groups(df.limit(0)).collect() == []


def test_large_bucket_is_cut_into_blocks(spark, monkeypatch):
    import tenura.llm.simhash as module
    monkeypatch.setattr(module, "BLOCK", 5)
    random.seed(3)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(60):
        copy = list(words)
        copy[random.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.fingerprint, r.component_id) for r in simhash_groups(df).collect()}
    assert got == brute(rows)


def test_wide_fingerprints_find_edited_copies(spark):
    random.seed(5)
    texts = [" ".join(f"t{random.randrange(10**6)}" for _ in range(300)) for _ in range(40)]
    edited = []
    for t in texts:
        words = t.split()
        words[100] = "edited"
        edited.append(" ".join(words))
    rows = list(enumerate(texts)) + [(i + 40, t) for i, t in enumerate(edited)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = simhash_groups(df, find=Print(2, 1), verify=Print(5, 12), max_distance=120).collect()
    assert {r.id: r.component_id for r in got} == {i: i % 40 for i in range(80)}


@pytest.mark.parametrize("edges", [
    [], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 50)], [(i, 100 + i % 7) for i in range(90)],
    [(5, 5), (-4, 9), (9, -4), (9, 3), (2**62, 3)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.id: r.component for r in connected_components(df).collect()}
    nodes = {n for e in edges for n in e}
    expected = roots(sorted(nodes), edges)
    assert {n: got.get(n, n) for n in nodes} == expected and set(got) <= nodes
