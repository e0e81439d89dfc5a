import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.ml import forest, validation
from tenura.sources.shared import pin, shared_dir, shuffles_dropped, unpin
from tests.test_forest import as_rows, sample, table_of


def coded_rows(spark, x, y):
    df = as_rows(spark, x, y)
    edges = forest.bin_edges(df)
    return pin(forest.coded(forest.feature_rows(df, "id"), edges), "test-coded"), edges


def test_dealt_rows_of_bins_take_bits_for_two_bins(spark):
    x, y = sample(400)
    x = np.concatenate([x, np.random.default_rng(1).integers(0, 2, (400, 9))], axis=1)
    rows, _ = coded_rows(spark, x, y)
    growth = forest.Growth(2, 2, False, True)
    tops, _ = forest._split_top(rows, growth, growth.variants[0], range(2), 400, 16, [])
    for r in forest._dealt(rows, growth, tops).collect():
        assert len(r.x) == 7 * len(r.labels)  # 11 columns of one or two bins in two bytes, five of a byte; 16 before


@pytest.mark.parametrize("random_cuts", [True, False])
def test_columns_come_back_from_packed_rows(random_cuts):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 5, (30, 75)).astype(float if random_cuts else np.uint8)
    values[:, :70] = rng.integers(0, 2, (30, 70))
    two = np.arange(75) < 70
    layout = forest.Layout(two, np.zeros(75), np.ones(75), "<f8" if random_cuts else "u1")
    data = layout.packed(values)
    assert data.shape[1] == layout.width == 9 + 5 * (8 if random_cuts else 1)
    words, table = layout.columns(data.tobytes(), 30)
    assert words.shape == (2, 30) and np.array_equal(table, values[:, 70:].T)
    bits = [words[i // 64] >> np.uint64(i % 64) & np.uint64(1) for i in range(70)]
    assert np.array_equal(np.stack(bits), values[:, :70].T)


@pytest.mark.parametrize("random_cuts", [True, False])
def test_many_bits_and_heavy_rows_give_the_same_trees(spark, monkeypatch, random_cuts):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (300, 70)).astype(float)
    x[:, 0] = rng.normal(size=300)
    y = (x[:, 0] + x[:, 1] + rng.normal(size=300) > 0.5).astype(int)
    growth = forest.Growth(2, 8, random_cuts, not random_cuts, None, ((1, 1.0, 1.0), (3, 0.7, 1.9)))
    if random_cuts:
        rows, edges = pin(forest.feature_rows(as_rows(spark, x, y), "id"), "test-rows"), []
    else:
        rows, edges = coded_rows(spark, x, y)
    whole = table_of(forest.grow_forest(rows, growth, 300, 70, edges))
    monkeypatch.setattr(forest, "DEALT_BYTES", 1)  # a tree at a time
    monkeypatch.setattr(forest, "BATCH_ROWS", 20)
    monkeypatch.setattr(forest, "CHUNK_ROWS", 16)
    assert table_of(forest.grow_forest(rows, growth, 300, 70, edges)) == whole


def test_tallies_of_any_size_are_exact():
    labels, weights = np.array([0, 1, 1, 0]), np.array([1, 2, 3, 1 << 21])
    tally = forest.Tally(labels, weights, True)
    assert len(tally.parts) == 2
    n, w0, w1 = tally.read([p.sum() for p in tally.parts])
    assert (n, w0, w1) == (4, 1 + (1 << 21), 5)
    n, w0, w1 = (v.tolist() for v in forest.Tally(labels, np.array([1, 2, 3, 4]), True).read([np.array([1 + (7 << 21) + (3 << 42)])]))
    assert (n, w0, w1) == ([1], [4], [3])


def test_settings_of_trees_share_lots(spark):
    x, y = sample()
    rows, edges = coded_rows(spark, x, y)
    held = pin(forest.feature_rows(as_rows(spark, x, y), "id"), "test-held")
    pieces = forest.grow_pieces(rows, forest.Growth(7, 2, False, True), len(y), x.shape[1], edges)
    cuts = [forest.Pruned(t, d) for t in (3, 7) for d in (2, None)]
    got = {r.row: r.scores for r in forest.piece_scores(pieces, held, len(y), 7, cuts).collect()}
    trees = [t for _, _, t in forest.trees_of(forest.nodes_of(pieces).toArrow())]
    for i, cut in enumerate(cuts):
        expected = np.mean([t.shares(cut)[t.leaves(x)] for t in trees[:cut.trees]], axis=0)
        assert {k: v[i] for k, v in got.items()} == pytest.approx(dict(enumerate(expected)), abs=1e-11)


def test_a_grid_leaves_neither_forests_nor_scores(features):
    folder = f"{shared_dir(features.sparkSession)}/tenura".removeprefix("file:")

    def left():
        return {p for p in subprocess.run(["ls", folder], capture_output=True, text=True).stdout.split() if p.startswith("grid-")}

    before = left()
    grid = {"trees": [1, 2], "depth": [2], "min_split": [2], "min_leaf": [4], "class_weight": [None]}
    assert len(validation.rf_grid_search(features, grid, folds=2).collect()) == 2
    assert left() == before


def test_unpin_deletes_pinned_tables_only(spark, tmp_path):
    table = pin(spark.range(5), "test-unpin")
    unpin(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0]).count()
    spark.range(3).write.parquet(f"{tmp_path}/own")
    with pytest.raises(ValueError):
        unpin(spark.read.parquet(f"{tmp_path}/own"))


def test_shuffle_setting_is_put_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    with shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
        assert spark.range(100).groupBy((F.col("id") % 7).alias("k")).count().count() == 7
    assert spark.conf.get(key, None) == old
