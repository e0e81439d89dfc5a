"""Document quality by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, and so have the strongest pairs
of features. Cyclic boosting visits the features in turn, and then the pairs, and
adds a small step of a shallow tree on the residuals each time. A score is the
sum of the table entries of a document's bins through the logistic function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import crc_slice, map_batches, table, with_text
from tenura.llm.html_text import STOP_WORDS

SAMPLE = 20_000  # labelled rows to fit on, at most
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 75, 8
STEP, PENALTY, LEAST = 0.1, 2.0, 1.0  # LEAST: hessian weight in a leaf, about nine rows where nine in ten are good

FEATURES = [
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "mark_share", "double_mark_share",
    "bar_share", "distinct_share", "top_share", "repeat_share", "stop_share", "marked_word_share",
    "line_length", "repeated_lines", "dots_per_word", "longest_word",
]

OTHER, LOWER, UPPER, DIGIT, SPACE, MARK = range(6)
_KIND = np.array([
    SPACE if c.isspace() else UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit()
    else MARK if c.isprintable() else OTHER
    for c in map(chr, range(0x600))
], dtype=np.uint8)


def features(text: str | None) -> list[float]:
    """The figures of a text in the order of ``FEATURES``; zeros for none."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    kind = _KIND[np.minimum(codes, 0x5FF)]
    count = np.bincount(kind, minlength=6)
    chars, n = len(codes), len(words)
    letters = max(1, count[LOWER] + count[UPPER])
    marks = kind == MARK
    seen = Counter(words)
    lines = Counter(line for line in text.split("\n") if line.strip())
    n_lines = max(1, sum(lines.values()))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    stops = sum(k for w, k in seen.items() if w.strip(".,!*#$%&|").lower() in STOP_WORDS)
    marked = sum(k for w, k in seen.items() if len(w) > 2 and not (w[-1].isalnum() or w[-2].isalnum()))
    return [
        np.log1p(chars), np.log1p(n), (chars - count[SPACE]) / n, count[UPPER] / letters, count[DIGIT] / chars,
        count[MARK] / chars, (marks[1:] & marks[:-1]).sum() / chars, seen.get("|", 0) / n, len(seen) / n,
        seen.most_common(1)[0][1] / n, repeats / n, stops / n, marked / n, np.log1p(chars / n_lines),
        1 - len(lines) / n_lines, text.count(".") / n, np.log1p(max(map(len, seen))),
    ]


def _best_cut(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins into a left and a right part."""
    g, h = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    total_g, total_h = gradient.sum(), weight.sum()
    right_g, right_h = total_g - g, total_h - h
    gain = g**2 / (h + PENALTY) + right_g**2 / (right_h + PENALTY) - total_g**2 / (total_h + PENALTY)
    gain[(h < LEAST) | (right_h < LEAST)] = 0
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) else (0.0, 0)


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of each bin of a tree over one axis."""
    gain, at = _best_cut(gradient, weight) if depth and len(gradient) > 1 else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(gradient), -gradient.sum() / (weight.sum() + PENALTY))
    return np.concatenate([shallow_tree(gradient[p], weight[p], depth - 1) for p in (slice(0, at), slice(at, None))])


def pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree over two axes: one cut of an axis and, in
    each part, a cut of the other."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros(gradient.shape))
    for turned in (False, True):
        g, h = (gradient.T, weight.T) if turned else (gradient, weight)
        for at in range(1, len(g)):
            parts, gain = [], 0.0
            for cut in (slice(0, at), slice(at, None)):
                by_g, by_h = g[cut].sum(axis=0), h[cut].sum(axis=0)
                if by_h.sum() < LEAST:
                    break
                part = shallow_tree(by_g, by_h, 1)
                gain -= (part * by_g).sum() + 0.5 * (part**2 * by_h).sum()
                parts.append(np.tile(part, (len(g[cut]), 1)))
            if len(parts) == 2 and gain > best[0]:
                values = np.concatenate(parts)
                best = (gain, values.T if turned else values)
    return best


@dataclass
class Additive:
    """Edges of the bins, a table per feature, and tables of coarser pairs."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def score(self, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return np.zeros(0)
        bins = self.bins(values)
        total = self.base + sum(t[bins[:, i]] for i, t in enumerate(self.tables))
        for (a, b), t in zip(self.pairs, self.pair_tables):
            total = total + t[bins[:, a] // 4, bins[:, b] // 4]
        return 1 / (1 + np.exp(-total))


def fit(values: np.ndarray, labels: np.ndarray) -> Additive:
    """Fit by cyclic boosting. One class or no rows give a constant score."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    base = float(np.log(share / (1 - share)))
    n = values.shape[1]
    if len(np.unique(labels)) < 2:
        return Additive(base, [np.empty(0)] * n, [np.zeros(1)] * n)
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(values[:, i], cuts)) for i in range(n)]
    model = Additive(base, edges, [np.zeros(len(e) + 1) for e in edges])
    bins = model.bins(values)
    total = np.full(len(labels), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - labels, p * (1 - p)

    for _ in range(ROUNDS):
        for i, t in enumerate(model.tables):
            g, h = slopes()
            step = STEP * shallow_tree(np.bincount(bins[:, i], g, len(t)), np.bincount(bins[:, i], h, len(t)))
            t += step
            total += step[bins[:, i]]

    coarse = bins // 4
    width = BINS // 4

    def grid(a: int, b: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        cell = coarse[:, a] * width + coarse[:, b]
        return pair_tree(*(np.bincount(cell, x, width**2).reshape(width, width) for x in (g, h)))

    ranked = sorted(((grid(a, b)[0], a, b) for a, b in combinations(range(n), 2)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((width, width)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(model.pairs, model.pair_tables):
            step = STEP * grid(a, b)[1]
            t += step
            total += step[coarse[:, a], coarse[:, b]]
    return model


def _measured(rows: DataFrame) -> DataFrame:
    """(label, values) of rows of (label, text)."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["label", "values"])

    return map_batches(rows, task, "label int, values array<double>")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Additive:
    """Model from labelled rows: at most ``sample`` of them, chosen by a hash of the
    id. Labels other than 0 and 1, and rows without id, teach nothing. The chosen
    labels (16 bytes each) are broadcast; only their documents are measured."""
    chosen = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("label", "text")
    found = _measured(rows).toArrow().combine_chunks()
    values = np.array(found.column("values").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort(np.c_[values, found.column("label").to_numpy()].T)  # the same fit however rows arrive
    return fit(values[order], found.column("label").to_numpy()[order].astype(np.float64))


def score(docs: DataFrame, model: Additive, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with ``score`` (0 to 1) and ``predicted``
    (1 from 0.5), which replace kept columns of such a name. Null, empty and blank
    texts are scored as texts of length 0."""
    keep = [c for c in keep if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, at, kept = with_text(docs, keep, text_col)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            found = shared.value.score(values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                [*keep, "score", "predicted"])

    return map_batches(rows, task, f"{kept}, score double, predicted int")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of the rows that may be learned from."""
    return labels.filter(crc_slice("doc_id", 3) != 1)


def op6_quality(spark, data_dir: str) -> DataFrame:
    """Quality of every document, learned from two of three crc32 slices.
    A row without doc_id is not held out."""
    docs = table(spark, data_dir, "documents").withColumn("held_out", F.coalesce(crc_slice("doc_id", 3) == 1, F.lit(False)))
    model = learn(docs, training_labels(table(spark, data_dir, "labels")))
    return score(docs, model, ["doc_id", "held_out"])
