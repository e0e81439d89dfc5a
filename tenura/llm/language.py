"""Language of documents by a mixture model over n-gram likelihoods.

Learning counts byte trigrams of lower-cased words per language. For a
document, each word has a likelihood under each language; expectation
maximisation estimates the shares of the languages, and languages are dropped
as long as that improves the penalised likelihood.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import crc_slice, map_batches, table, with_text

UNDECIDED = "und"
BUCKETS = 1 << 16  # hashed trigrams; bounds the model per language
SMOOTHING = 0.5
WORD = re.compile(r"[^\W\d_]+")
PIECE = 1 << 18  # characters of a text handled at a time
WORDS = 1 << 14  # words whose likelihoods are looked up at a time
SPREAD = 30.0  # largest log ratio of a word's likelihoods that counts
STEPS = 40


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, each padded by a space on both sides, and
    the position where each word begins. A word has as many as it has bytes."""
    data = (" " + " ".join(words) + " ").encode("utf-8", "replace")
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    grams = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
    kept = codes[1:-1] != 32
    hashed = (grams[kept] * np.uint32(2654435761)) >> np.uint32(16)
    starts = np.flatnonzero(codes[:-1] == 32)[: len(words)]
    return hashed, starts - np.arange(len(starts))


def pieces_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text, a stretch of about PIECE characters at a time. A stretch
    ends where a word does."""
    start, end = 0, len(text or "")
    while start < end:
        stop = min(end, start + PIECE)
        inside = WORD.match(text, stop - 1) if stop < end else None
        stop = inside.end() if inside else stop
        yield WORD.findall(text[start:stop].lower())
        start = stop


def words_of(text: str | None) -> dict[str, int]:
    """Distinct words and how often they come."""
    counts: Counter[str] = Counter()
    for words in pieces_of(text):
        counts.update(words)
    return counts


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # (languages, BUCKETS)

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """(words, languages) log likelihoods; WORDS words at a time, as each of their
        bytes is looked up in every language."""
        found = []
        for at in range(0, len(words), WORDS):
            hashed, starts = trigrams(words[at:at + WORDS])
            found.append(np.add.reduceat(self.logs[:, hashed], starts, axis=1).T)
        return np.concatenate(found)

    def shares(self, words: dict[str, int]) -> np.ndarray:
        """Share of each language; zero for those that aren't in the set."""
        logs = self.likelihoods(list(words))
        times = np.fromiter(words.values(), np.float64, len(words))
        ratio = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -SPREAD))
        chosen = np.arange(len(self.languages))
        share, fit = mixture(ratio, times)
        # One more language costs its share, and a name out of all languages.
        cost = 0.5 * np.log(times.sum()) + np.log(len(self.languages))
        while len(chosen) > 1:
            rest = np.delete(np.arange(len(chosen)), share.argmin())
            less, less_fit = mixture(ratio[:, chosen[rest]], times)
            if less_fit + cost < fit:
                break
            chosen, share, fit = chosen[rest], less, less_fit
        out = np.zeros(len(self.languages))
        out[chosen] = share
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNDECIDED, 0.0
        shares = self.shares(words)
        best = int(shares.argmax())
        return self.languages[best], min(1.0, float(shares[best]))


def mixture(ratio: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares by expectation maximisation, and the log likelihood, of distinct words
    that come so many times."""
    n, k = times.sum(), ratio.shape[1]
    share = np.full(k, 1 / k)
    if k > 1:
        for _ in range(STEPS):
            moved = share * (ratio.T @ (times / (ratio @ share))) / n
            done = np.abs(moved - share).max() < 1e-4
            share = moved / moved.sum()
            if done:
                break
    return share, float(times @ np.log(ratio @ share))


def trigram_counts(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """(lang, bucket, n) over all rows; each task sends sums."""

    def rows(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for language, count in counts.items():
            have = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(have), pa.string()), pa.array(have.astype(np.int32)), pa.array(count[have])],
                ["lang", "bucket", "n"])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, language in zip(batch.column(0), batch.column(1).to_pylist()):
                for words in pieces_of(text.as_py()):
                    if not words:
                        continue
                    hashed, _ = trigrams(words)
                    found = np.bincount(hashed, minlength=BUCKETS)
                    counts[language] = counts[language] + found if language in counts else found
                if len(counts) > 100:
                    yield from rows(counts)
                    counts = {}
        yield from rows(counts)

    found = map_batches(docs.select(text.alias("text"), lang.alias("lang")), task, "lang string, bucket int, n bigint")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of the languages named in ``docs``: ``BUCKETS`` numbers for each.
    Rows without text or language teach nothing."""
    text, lang = F.col(text_col), F.col(lang_col)
    counts = trigram_counts(docs.filter(text.isNotNull() & lang.isNotNull()), text, lang).toArrow()
    names = counts.column("lang").to_pylist()
    languages = sorted(set(names))
    number = {language: i for i, language in enumerate(languages)}
    total = np.full((len(languages), BUCKETS), SMOOTHING)
    if languages:
        rows = np.array([number[x] for x in names])
        total[rows, counts.column("bucket").to_numpy()] += counts.column("n").to_numpy()
    return Model(languages, np.log(total / total.sum(axis=1, keepdims=True)))


def label(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with ``lang_pred``, ``score`` (the share of
    that language) and ``shares`` of all languages found.

    Text that is null or has no letter gives ``und`` with score 0 and no shares; so
    does every text if no language was learned. Equal shares go to the language
    first in the alphabet."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, at, kept = with_text(docs, keep, text_col)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores, mixes = [], [], []
            for text in batch.column(at):
                words = words_of(text.as_py())
                shares = model.shares(words) if words and model.languages else np.zeros(0)
                best = int(shares.argmax()) if len(shares) else -1
                names.append(model.languages[best] if len(shares) else UNDECIDED)
                scores.append(min(1.0, float(shares[best])) if len(shares) else 0.0)
                mixes.append([(model.languages[i], float(shares[i])) for i in np.flatnonzero(shares)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(mixes, pa.map_(pa.string(), pa.float64()))],
                [*keep, "lang_pred", "score", "shares"])

    return map_batches(rows, task, f"{kept}, lang_pred string, score double, shares map<string,double>")


def op5_language_id(spark, data_dir: str) -> DataFrame:
    """Language of every document, learned from three of four crc32 slices.
    A row without doc_id is neither held out nor learned from."""
    docs = table(spark, data_dir, "documents").withColumn("held_out", F.coalesce(crc_slice("doc_id", 4) == 2, F.lit(False)))
    model = learn(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return label(docs, model, ["doc_id", "held_out"])
