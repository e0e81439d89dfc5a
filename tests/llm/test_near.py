import random

import numpy as np
import pytest

import tenura.llm.near as near
from tenura.llm.near import band_keys, near_groups
from tenura.llm.simhash import shingle_hashes

from .test_simhash import roots


def shingles(text):
    words = text.lower().split()
    return frozenset(zip(*(words[i:] for i in range(5)))) or frozenset([tuple(words)])


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, words, kind, share):
    """A passage appended, cut or replaced, so that about ``share`` of the shingles stay."""
    n = len(words)
    new = [f"n{rng.randrange(10**6)}" for _ in range(n)]
    if kind == "appended":
        return words + new[: round(n / share) - n]
    if kind == "cut":
        return words[: round(n * share)]
    size = round(n * (1 - share) / (1 + share)) - 4
    at = rng.randrange(n - size)
    return words[:at] + new[:size] + words[at + size:]


def pairs(kind, count, low=0.8, high=0.9, seed=1):
    """Text pairs whose exact similarity is from ``low`` to ``high``."""
    rng, out = random.Random(f"{kind}{seed}"), []
    while len(out) < count:
        words = [f"t{rng.randrange(3000)}" for _ in range(rng.randrange(150, 900))]
        pair = " ".join(words), " ".join(edited(rng, words, kind, rng.uniform(low, high)))
        if low <= similar(*pair) <= high:
            out.append(pair)
    return out


@pytest.mark.parametrize("kind", ["appended", "cut", "replaced"])
def test_candidates_of_edited_texts(kind):
    keys = [[band_keys(np.unique(shingle_hashes(t.encode(), 5))) for t in pair] for pair in pairs(kind, 400)]
    assert sum(bool((a == b).any()) for a, b in keys) == 400


def grouped(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.id: r.component_id for r in near_groups(df).collect()}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1:] if 5 * len(x & y) >= 4 * len(x | y)]
    return roots([i for i, _ in rows], links)


def test_links_are_exact_on_both_sides_of_the_threshold(spark):
    kinds = ("appended", "cut", "replaced")
    both = [p for k in kinds for low, high in ((0.7, 0.8), (0.8, 0.9)) for p in pairs(k, 60, low, high, seed=low)]
    rows = [(i, t) for i, t in enumerate(t for pair in both for t in pair)]
    got = grouped(spark, rows)
    for n, pair in enumerate(both):
        assert (got[2 * n] == got[2 * n + 1]) == (similar(*pair) >= 0.8), similar(*pair)


@pytest.mark.parametrize("block", [256, 7])
def test_chains_and_short_texts_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "TEXTS", block)
    rng, rows = random.Random(4), []
    for start in range(6):
        words = [f"w{start}-{i}" for i in range(200 if start else 9)]
        for step in range(25):
            rows.append((len(rows), " ".join(words)))
            at = rng.randrange(len(words))
            words = words[:at] + [f"x{start}-{step}-{i}" for i in range(1 + step % 3)] + words[at + rng.randrange(4):]
    rows += [(1000 + i, " ".join(f"s{k}" for k in range(i))) for i in range(40)]
    assert grouped(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [256, 5])
def test_large_groups_with_strays_equal_brute_force(spark, monkeypatch, block):
    """Many near copies of one text, and texts that are like some of them but not
    alike enough, which travel to every block."""
    monkeypatch.setattr(near, "TEXTS", block)
    monkeypatch.setattr(near, "LOOSE", 300)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        some = list(words)
        for _ in range(rng.randrange(5)):
            some[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(some)))
    strays = [words[:60] + [f"s{k}-{i}" for i in range(60)] for k in range(8)]
    rows += [(len(rows) + k, " ".join(s)) for k, s in enumerate(strays)]
    rows += [(len(rows) + k, " ".join(s + ["end"])) for k, s in enumerate(strays[:4])]
    got = grouped(spark, rows)
    assert got == brute(rows) and len(set(got.values())) > 8


def test_simhash_keys_find_candidates_without_bands(spark, monkeypatch):
    monkeypatch.setattr(near, "band_keys", lambda hashes: np.empty(0, dtype=np.int64))
    words = [f"w{i}" for i in range(3000)]
    rows = [(4, " ".join(words)), (2, " ".join(words[:-2] + ["x"])), (7, " ".join(words[::-1])), (9, "")]
    assert grouped(spark, rows) == {4: 2, 2: 2, 7: 7, 9: 9}


def test_edges(spark):
    rows = [(5, "a b c"), (3, "A  b\tC"), (9, None), (8, ""), (7, " \n"), (2, "long words " * 40_000), (1, "one"), (1, "one"), (None, "one"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, near_groups(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 7), (8, 7), (7, 7), (2, 2), (1, 1), (1, 1), (None, 1), (None, None)], key=str)
    assert near_groups(df.limit(0)).collect() == []
