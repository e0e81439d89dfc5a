"""Licence scan with a generalised suffix automaton.

The automaton holds every passage of all licence templates. A text is streamed
through it once: after each word it tells the longest passage that ends there
(matching statistics). Phrases are read off directly, as they are suffixes of such
a passage; long passages are chained, in the order of a template and of the
text, into spans, and a template counts where a chain covers most of it.
"""

from __future__ import annotations

from bisect import bisect
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import byte_items, map_batches, table
from tenura.llm.licence_texts import PHRASES, TEMPLATES

LONG = 4  # words of a passage that chains begin with
GAP = 24  # words that may lie between two passages of a chain, on either side
COVERED = 0.75  # share of a template that a chain has to cover
LOWER = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()

Templates = Sequence[tuple[str, str]]


def words_of(data: bytes) -> list[bytes]:
    """Words with A-Z lower-cased: ASCII letters and digits, and all beyond ASCII."""
    return data.translate(LOWER).split()


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.after: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, number of its last word)
        for number, sequence in enumerate(sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = self._extend(state, word)
                self.ends[state].append((number, place))
        # A passage also ends where a longer one does that it is a suffix of.
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] += self.ends[state]
        self.ends[0] = []

    def _add(self, length: int, after: dict[int, int], link: int) -> int:
        self.after.append(after)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The target of ``word`` cut down to the passages that end with ``state``'s."""
        if self.length[target] == self.length[state] + 1:
            return target
        part = self._add(self.length[state] + 1, dict(self.after[target]), self.link[target])
        self.link[target] = part
        while state >= 0 and self.after[state].get(word) == target:
            self.after[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, state: int, word: int) -> int:
        if word in self.after[state]:  # another sequence has this passage
            return self._split(state, word, self.after[state][word])
        new = self._add(self.length[state] + 1, {}, 0)
        while state >= 0 and word not in self.after[state]:
            self.after[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.after[state][word])
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest passage that ends with ``word``."""
        while state and word not in self.after[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.after[state]:
            return self.after[state][word], length + 1
        return 0, 0

    def suffixes(self, state: int) -> Iterator[int]:
        while state > 0:
            yield state
            state = self.link[state]


@dataclass(slots=True)
class Chain:
    """Passages in order: the words of text and template they run to, where the
    first begins, and the template's words they cover."""

    first: int
    last: int
    at: int
    covered: int


class Scanner:
    def __init__(self, phrases: Templates, templates: Templates):
        self.labels = [label for label, _ in [*phrases, *templates]]
        texts = [words_of(text.encode()) for _, text in [*phrases, *templates]]
        self.known = {w: i for i, w in enumerate(dict.fromkeys(w for text in texts for w in text))}
        self.sequences = [[self.known[w] for w in text] for text in texts]
        self.n_phrases = len(phrases)
        self.shortest = min([LONG, *map(len, self.sequences[:self.n_phrases])])
        self.automaton = Automaton(self.sequences)
        at = {}
        for number, sequence in enumerate(self.sequences[:self.n_phrases]):
            state = 0
            for word in sequence:
                state = self.automaton.after[state][word]
            at.setdefault(state, []).append((number, len(sequence)))
        # Phrases that may end with a state's passage, with their lengths.
        self.phrases_at = [[p for s in self.automaton.suffixes(state) for p in at.get(s, [])]
                           for state in range(len(self.automaton.link))]

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of each word that ends a passage long enough to matter."""
        step, state, length, before = self.automaton.step, 0, 0, -2
        for place, word in enumerate(map(self.known.get, words)):
            if word is None:
                continue
            if place != before + 1:
                state, length = 0, 0
            before = place
            state, length = step(state, length, word)
            if length >= self.shortest:
                yield place, state, length

    def scan(self, data: bytes) -> tuple[int, list[dict]]:
        """(number of words, spans): phrases at all their places and the templates
        that chains cover, with label, number, first and last word and share."""
        words = words_of(data)
        spans, passages, open_passage = [], [], None
        for place, state, length in self.statistics(words):
            for number, size in self.phrases_at[state]:
                if size <= length:
                    spans.append(self._span(number, place - size + 1, place, size))
            if open_passage and not (place == open_passage[0] + 1 and length == open_passage[2] + 1):
                passages.append(open_passage)
            open_passage = (place, state, length) if length >= LONG else None
        if open_passage:
            passages.append(open_passage)
        return len(words), spans + self._covered(passages)

    def _span(self, number: int, first: int, last: int, covered: int) -> dict:
        return {"label": self.labels[number], "template": number, "first_word": first, "last_word": last,
                "covered": covered, "share": covered / len(self.sequences[number])}

    def _covered(self, passages: list[tuple[int, int, int]]) -> list[dict]:
        """Templates that chains of these passages cover."""
        recent: dict[int, deque[Chain]] = {}
        enough: dict[int, list[Chain]] = {}
        for place, state, length in passages:
            for number, at in self.automaton.ends[state]:
                if number < self.n_phrases:
                    continue
                chains = recent.setdefault(number, deque())
                while chains and chains[0].last < place - length - GAP:
                    chains.popleft()
                best = Chain(place - length + 1, place, at, length)
                for c in chains:
                    # Words that both passages have count once.
                    again = max(0, c.last - (place - length), c.at - (at - length))
                    if c.last < place and 0 < at - c.at <= length + GAP and again < length:
                        if c.covered + length - again > best.covered:
                            best = Chain(c.first, place, at, c.covered + length - again)
                chains.append(best)
                if best.covered >= COVERED * len(self.sequences[number]):
                    enough.setdefault(number, []).append(best)
        return [self._span(number, c.first, c.last, c.covered)
                for number, chains in enough.items() for c in _apart(chains)]


def _apart(chains: list[Chain]) -> list[Chain]:
    """Chains that share no word of the text, the ones that cover most first."""
    taken: list[Chain] = []
    for chain in sorted(chains, key=lambda c: (-c.covered, c.last - c.first, c.first)):
        at = bisect(taken, chain.first, key=lambda c: c.first)
        if (at == 0 or taken[at - 1].last < chain.first) and (at == len(taken) or taken[at].first > chain.last):
            taken.insert(at, chain)
    return taken


@cache
def scanner(phrases: tuple, templates: tuple) -> Scanner:
    """One for all tasks of a Python worker."""
    return Scanner(phrases, templates)


SPAN = ("struct<label:string,template:int,first_word:bigint,last_word:bigint,covered:bigint,share:double>")
_SPAN = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()),
                   ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])


def scan(docs: DataFrame, phrases: Templates = PHRASES, templates: Templates = TEMPLATES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans): the licences of every whole text.

    A span names its label, the number of its template (phrases first), its first
    and last word (from 0), the template's words it covers and their share. Phrases
    are listed at all places where their words stand consecutively; of a template
    the spans do not overlap. A null or empty text has no words and no spans;
    repeated rows and null ids are rows like any other, other columns are not read, an
    empty table gives no rows. Nothing is shuffled; the automaton's size depends on the
    templates alone, the work on a text is in proportion to its words."""
    given = tuple(map(tuple, phrases)), tuple(map(tuple, templates))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = scanner(*given).scan
        for batch in batches:
            found = [look(data or b"") for data in byte_items(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([s for _, s in found], pa.list_(_SPAN))], ["doc_id", "n_words", "spans"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, task, f"doc_id bigint, n_words bigint, spans array<{SPAN}>")


def op12_licence_scan(spark, data_dir: str) -> DataFrame:
    """Licence labels of every document: base phrases, and templates of the method."""
    found = scan(table(spark, data_dir, "documents"))
    base = F.filter("spans", lambda s: s["template"] < len(PHRASES))
    starts = F.transform("base", lambda s: s["first_word"])

    def named(spans: str):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named("base").alias("base_labels"), named("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"))
