import math
import random

import numpy as np
import pytest

from tenura.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, n_pos=5, n_neg=10):
    usable = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        usable.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for at, (anchor, a, label) in enumerate(usable):
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i, other_label == label)
                        for j, (i, v, other_label) in enumerate(usable) if j != at and len(v) == len(a))
        for place, (minus, positive, _) in enumerate([s for s in scored if s[2]][:n_pos], 1):
            inside = [s for s in scored if not s[2] and 30 * -minus <= 100 * -s[0] <= 90 * -minus]
            out += [(anchor, positive, rank, i, -minus, -m, place) for rank, (m, i, _) in enumerate(inside[:n_neg], 1)]
    return sorted(out)


def found(spark, path, rows, schema=SCHEMA):
    path.mkdir()
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(path / "embeddings.parquet"))
    return sorted(tuple(r) for r in negatives.op13_hard_negatives(spark, str(path)).collect())


def clustered(rng, n, dims=6, labels=4):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    return [(i, [c + rng.gauss(0, 0.6) for c in centres[i % labels]], i % labels) for i in range(n)]


@pytest.mark.parametrize("block, lot", [(4096, 2048), (50, 2)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, block, lot):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "LOT", lot)
    rng = random.Random(1)
    rows = clustered(rng, 900)
    # Ties, a hot label, repeated ids, small whole-number components.
    rows += [(1000 + i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(6)], rng.choice([0, 0, 0, 1])) for i in range(400)]
    rows += [(r[0], r[1], r[2]) for r in rows[:40]] + [(100, [1.0] * 6, 3), (200, [0.0] * 6, 2)]
    got = found(spark, tmp_path / "a", rows)
    assert got == brute(rows) and len(got) > 200


def test_awkward_rows(spark, tmp_path):
    rows = [
        (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.2], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [], 2),
        (6, [float("nan"), 1.0], 2), (8, [float("inf"), 1.0], 2), (9, [0.5, 0.2], None), (None, [0.5, 0.2], 2),
        (10, [0.5, 0.2, 0.1], 2), (100, [0.5, 0.2, 0.1], 1), (101, [0.3, 0.2, 0.1], 1), (102, [0.2, 0.1, 0.1], 3),
        (200, [-1.0, -1.0], 5), (201, [1.0, 1.0], 5), (300, [1.0], 6), (-100, [0.7, 0.1], 1), (400, [1e30, 1e30], 7),
    ]
    got = found(spark, tmp_path / "a", rows[:-1])
    assert got == brute(rows[:-1]) and got
    found(spark, tmp_path / "b", rows)  # beyond a bigint: no crash
    assert found(spark, tmp_path / "c", []) == []
    schema = SCHEMA + ", row int, id string, asks string, size int, vec string, part int, lot int, n int, m int, v int"
    wide = [(*r, 1, "x", "y", 2, "z", 3, 4, 5, 6, 7) for r in rows[:3]]
    assert found(spark, tmp_path / "d", wide, schema) == brute(rows[:3])


def test_large_components_are_exact(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 2**20)) for _ in range(4)], i % 2) for i in range(60)]
    assert found(spark, tmp_path / "a", rows) == brute(rows)


def test_reading_stops_before_the_end():
    """Lists whose heads hold the best rows are not read to the end."""
    rng = np.random.default_rng(2)
    values = np.floor(rng.normal(0, 5, (4000, 3)))
    values[:20] += 500
    lists = negatives.Lists(values)
    at, scores = lists.search(np.array([3.0, 2.0, 1.0]), [negatives.Span(negatives.LOWEST, negatives.HIGHEST, 5)])
    assert len(at) < 400
    whole = values @ [3, 2, 1]
    assert sorted(scores)[-5:] == sorted(whole)[-5:]


def test_windows_stop_only_when_strictly_below(spark):
    rng = np.random.default_rng(3)
    for _ in range(200):
        values = rng.integers(-3, 4, (60, 4)).astype(float)
        anchor = rng.integers(-2, 3, 4).astype(float)
        whole = (values @ anchor).astype(int)
        low, high = sorted(rng.integers(-20, 21, 2).tolist())
        at, scores = negatives.Lists(values).search(anchor, [negatives.Span(low, high, 4)])
        best = negatives.best_of(at[(scores >= low) & (scores <= high)], scores[(scores >= low) & (scores <= high)], 4)
        got = at[(scores >= low) & (scores <= high)][best].tolist()
        inside = [i for i in range(60) if low <= whole[i] <= high]
        assert got == sorted(inside, key=lambda i: (-whole[i], i))[:4]


def test_sql_says_the_same(spark, duck):
    from tests.conftest import DATA
    got = sorted(tuple(r) for r in negatives.op13_hard_negatives(spark, DATA).collect())
    assert got == sorted(duck.execute(negatives.OP13_SQL).fetchall()) and got
