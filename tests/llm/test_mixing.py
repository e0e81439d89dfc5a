import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tenura.llm.mixing import exponent_figures, find_exponent, mix, op10_source_mix

from ..conftest import DATA

SCHEMA = "doc_id bigint, source string, n bigint"


def sample(spark, seed=1, sizes=(600, 90, 30)):
    rng = random.Random(seed)
    rows, i = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            rows.append((i, f"s{s}", rng.randint(1, 50)))
            i += 1
    return rows, spark.createDataFrame(rows, SCHEMA)


def tokens_by_source(rows, got):
    size = {i: n for i, _, n in rows}
    out = Counter()
    for r in got:
        out[r.source] += size[r.doc_id]
    return out


def brute_exponent(sizes, entropy=None, repeats=None, budget=None):
    """Smallest exponent on a fine grid that meets the limits."""
    total = sum(sizes)
    shares = [s / total for s in sizes]
    for step in range(0, 80_001):
        t = step / 10_000
        powers = [p**t for p in shares]
        weights = [x / sum(powers) for x in powers]
        times = [w / p for w, p in zip(weights, shares)]
        most = max(times) / min(times) if budget is None else budget / total * max(times)
        if (entropy is None or -sum(w * math.log(w) for w in weights) <= entropy + 1e-9) and (
                repeats is None or most <= repeats * (1 + 1e-9)):
            return t
    return None


@pytest.mark.parametrize("limits", [{"entropy": 0.9}, {"repeats": 2.0}, {"repeats": 1.5, "budget": 5000}, {"entropy": 1.0, "repeats": 4.0}])
def test_exponent(spark, limits):
    sizes = [7000, 900, 2100]
    shares = spark.createDataFrame([(s / 10_000,) for s in sizes], "share double")
    budget = limits.get("budget")
    found = find_exponent(shares, limits.get("entropy"), limits.get("repeats"), None if budget is None else budget / 10_000)
    assert found == pytest.approx(brute_exponent(sizes, **limits), abs=2e-4)


def test_figures(spark):
    shares = spark.createDataFrame([(0.5,), (0.25,), (0.25,)], "share double")
    (total, entropy, high, low), = exponent_figures(shares, [0.0])
    assert (total, high, low) == (3, 4, 2) and entropy == pytest.approx(math.log(3))


def test_repeat_limit_without_budget(spark):
    rows, df = sample(spark)
    got = mix(df, tokens=F.col("n"), max_repeats=3.0).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) == {i for i, _, _ in rows} and max(copies.values()) <= 3
    before, after = tokens_by_source(rows, [type("R", (), dict(source=s, doc_id=i)) for i, s, _ in rows]), tokens_by_source(rows, got)
    shares = {s: n / sum(before.values()) for s, n in before.items()}
    high = max(shares.values())
    t = brute_exponent([before[s] for s in sorted(before)], repeats=3.0)
    for s, p in shares.items():
        wanted = before[s] * (p / high) ** (t - 1)
        assert wanted - 60 <= after[s] <= wanted + 10
    assert all(len({r.epoch for r in got if r.doc_id == i}) == n for i, n in list(copies.items())[:50])


def test_budget_is_kept(spark):
    rows, df = sample(spark)
    total = sum(n for _, _, n in rows)
    for budget in (total // 3, total, 2 * total):
        after = tokens_by_source(rows, mix(df, tokens=F.col("n"), max_repeats=2.5, budget=budget).collect())
        assert budget - 3 * 50 <= sum(after.values()) <= budget + 3


def test_epochs_are_permutations(spark):
    rows, df = sample(spark, sizes=(100, 1500))
    got = mix(df, tokens=F.col("n"), max_repeats=5.0).collect()
    orders = {}
    for r in sorted(got, key=lambda r: r.position):
        orders.setdefault((r.source, r.epoch), []).append(r.doc_id)
    small = [o for (s, _), o in orders.items() if s == "s0"]
    assert len(small) >= 2 and small[0] != small[1] and set(small[0]) == set(range(100))
    assert all(0 <= r.position <= 1 for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(df.repartition(5), tokens=F.col("n"), max_repeats=5.0).collect()))


def test_edges(spark):
    rows = [(1, None, "a b"), (2, None, "c d"), (3, "x", None), (4, "x", ""), (5, "y", "w " * 200_000), (6, "y", "w"), (6, "y", "w"), (None, "z", "q r")]
    df = spark.createDataFrame([(*r, 0, 9) for r in rows], "doc_id bigint, source string, text string, epoch int, tokens int")
    got = mix(df, max_repeats=1.0).collect()
    assert sorted(((r.doc_id or 0, r.epoch) for r in got)) == sorted((r[0] or 0, 0) for r in rows)
    assert mix(df).columns == ["doc_id", "source", "text", "tokens", "epoch", "position"]
    assert mix(df.limit(0), max_repeats=2.0).collect() == []
    assert len(mix(df.filter("source = 'x'"), max_repeats=2.0).collect()) == 2


def test_query(spark):
    docs = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    copies = Counter(r.doc_id for r in op10_source_mix(spark, DATA).collect())
    assert set(copies) == docs and max(copies.values()) <= 2


def test_clashing_names_keep_their_values(spark):
    names = ["repeats", "left", "epochs", "end_doc", "end_block", "__source", "__id", "__blocks", "__doc", "epoch"]
    rows = [(i, "some words here", "ab"[i % 2], *range(len(names))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    found = mix(df, max_repeats=2.0)
    assert found.columns == ["doc_id", "text", "source", *names[:-1], "epoch", "position"]
    got = found.collect()
    assert {r.doc_id for r in got} == set(range(20)) and all(r["left"] == 1 and r["__doc"] == 8 for r in got)
