"""Packing of documents into token sequences of bounded length, in order.

The documents of a partition form one stream of tokens. Window cuts may fall on
the ends of documents, on the ends of sentences, and on a grid inside very long
sentences and before the end of the stream. A dynamic program over these places
picks the cuts with the least padding plus penalties for cutting documents and
sentences; a monotone queue gives the best start of each window in constant time.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenura.llm.alignment import byte_alphabet
from tenura.llm.common import map_batches, remembered, table

LENGTH = 4096
DOCUMENT, SENTENCE, INSIDE = 0, 4, 64  # penalty of a cut, in tokens of padding
SEQUENCE = 8  # price of one more sequence
GRID = 64  # distance of places inside sentences
STREAM = 1 << 20  # tokens packed together
WORDS_KEPT, PARTS_KEPT = 96 << 20, 48 << 20  # bytes, about, that a Python worker remembers
DOCS = 512  # documents whose words are looked up together
MARKS = ".,!?;:*#$%&"
LAST_LATIN, DOTTED_I = "\u024f", "\u0130"
WORD_END, END_MARK, EXTRA_RANKS = "</w>", "\uf8ff", 2
SPACE = re.compile(r"[^ \n\t\r]+")
SENTENCE_ENDS = tuple(end + mark for end in ".!?" for mark in ("", '"', "'", ")", "»", "”"))


class Store:
    """Token ids of strings, one after the other in one array, by number."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids = np.empty(1 << 12, dtype="<u4")
        self.starts = np.zeros(1 << 10, dtype=np.int64)
        self.held = 0

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.number)
        begin = int(self.starts[at])
        while at + len(strings) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while begin + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[begin:begin + len(ids)] = ids
        self.starts[at + 1:at + 1 + len(strings)] = begin + np.cumsum(sizes)
        self.number.update(zip(strings, range(at, at + len(strings))))
        self.held += 170 * len(strings) + sum(map(len, strings)) + 4 * len(ids)

    def numbers(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, strings), np.int64, len(strings))

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these strings in order, and how many each has."""
        starts = self.starts[numbers]
        sizes = self.starts[numbers + 1] - starts
        shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        return self.ids[np.arange(len(shift)) + shift], sizes


class Encoder:
    """Token ids of texts. Words between white space are encoded once and
    remembered: no token of this vocabulary reaches over white space."""

    def __init__(self, path: str, end_id: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        sizes = {i: len(t.removesuffix(WORD_END)) for t, i in self.tokenizer.get_vocab().items()}
        self.size_of = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)])
        self.by_rank = _by_rank(path)
        self.forget_words()
        self.forget_parts()

    def forget_words(self) -> None:
        self.words, self.ending = Store(), np.zeros(0, dtype=bool)

    def forget_parts(self) -> None:
        self.parts = Store()
        self.parts.add([""], self.parts.ids[:0], np.zeros(1, dtype=np.int64))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words by number, new ones after they were encoded."""
        if self.words.held > WORDS_KEPT:
            self.forget_words()
        if self.parts.held > PARTS_KEPT:
            self.forget_parts()
        known = self.words.number
        found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(found < 0)
        if len(missed):
            some = list(map(words.__getitem__, missed.tolist()))
            self._learn(list(dict.fromkeys(some)))
            found[missed] = self.words.numbers(some)
        return found

    def _learn(self, new: list[str]) -> None:
        halves = [half for w in new for half in _halves(w)]
        known = self.parts.number
        self._encode_parts([p for p in dict.fromkeys(halves) if p not in known])
        ids, sizes = self.parts.joined(self.parts.numbers(halves))
        self.words.add(new, ids, sizes.reshape(-1, 2).sum(axis=1))
        self.ending = np.concatenate([self.ending, [w.endswith(SENTENCE_ENDS) for w in new]])

    def _encode_parts(self, parts: list[str]) -> None:
        """Encode parts as one text. Tokens are told apart by the bytes they stand for;
        of characters that may become more or fewer bytes, by their offsets."""
        letters, plain, other = [], [], []
        for part in parts:
            kind = plain if _same_size(part) else other
            (letters if self.by_rank and kind is plain and part.isalpha() else kind).append(part)
        if letters:
            text = f"{END_MARK} ".join(letters).lower() + END_MARK
            ids = np.array(self.by_rank.encode_ordinary(text), dtype="<u4") - EXTRA_RANKS
            if not self._added(letters, ids):
                plain += letters
        if plain:
            found = self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0]
            if not self._added(plain, np.array(found.ids, dtype="<u4")):
                other += plain
        if other:
            found = self.tokenizer.encode(" ".join(other), add_special_tokens=False)
            begins = np.array([start for start, _ in found.offsets])
            cuts = np.searchsorted(begins, np.cumsum([len(p) + 1 for p in other]))
            self.parts.add(other, np.array(found.ids, dtype="<u4"), np.diff(cuts, prepend=0))

    def _added(self, parts: list[str], ids: np.ndarray) -> bool:
        """Tell the ids of the parts apart by the bytes that they stand for; False if
        these don't end where the parts do."""
        ends = np.cumsum(self.size_of[ids])
        wanted = np.cumsum([len(p) if p.isascii() else len(p.lower().encode()) for p in parts])
        cuts = np.searchsorted(ends, wanted)
        if cuts[-1] + 1 != len(ids) or (ends[np.minimum(cuts, len(ids) - 1)] != wanted).any():
            return False
        self.parts.add(parts, ids, np.diff(cuts, prepend=-1))
        return True

    def encode(self, text: str | None) -> tuple[bytes, list[int]]:
        """Ids with the end id, as little-endian bytes, and the token counts
        up to the end of each sentence."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[bytes, list[int]]]:
        split = [split_words(t) if t else [] for t in texts]
        found = self.numbers([w for words in split for w in words])
        end = np.array([self.end_id], dtype="<u4").tobytes()
        at = 0
        for words in split:
            numbers = found[at:at + len(words)]
            at += len(words)
            ids, sizes = self.words.joined(numbers)
            upto = np.cumsum(sizes)
            yield ids.tobytes() + end, upto[self.ending[numbers]].tolist()


def _by_rank(path: str) -> tiktoken.Encoding | None:
    """The vocabulary's merges by rank, for words of letters, which are several times
    faster so. The end of a word is a character of three bytes that no such word
    has; joining these bytes, and these with the byte before, comes first. None if
    the ids of the merges don't rise in their order."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    alphabet, vocabulary, end = byte_alphabet(), model["vocab"], END_MARK.encode()
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    first = [vocabulary[c + tail] for c in alphabet for tail in ("", WORD_END)]
    if model.get("end_of_word_suffix") != WORD_END or merged != sorted(merged) or max(first) > min(merged):
        return None
    ranks = {end[:2]: 0, end: 1}
    for token, number in vocabulary.items():
        core = token.removesuffix(WORD_END)
        if core and all(c in alphabet for c in core):
            data = bytes(alphabet[c] for c in core) + (end if core != token else b"")
            ranks[data] = number + EXTRA_RANKS
    return tiktoken.Encoding("own", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})


def _same_size(part: str) -> bool:
    """Lower-casing is all that the vocabulary does to it; no special token."""
    return "|" not in part and (part.isascii() or (max(part) <= LAST_LATIN and DOTTED_I not in part))


def _halves(word: str) -> tuple[str, str]:
    """A word as core and final marks, if the vocabulary cuts it there in any case:
    marks after a Latin letter or digit are tokens of their own. The vocabulary
    knows no capitals, so such a core is lower-cased. Special tokens and other
    scripts stay whole."""
    if word.isascii() and word.isalnum():
        low = word.lower()
        return word if low == word else low, ""
    core = word.rstrip(MARKS)
    if not core or not core[-1].isalnum() or "|" in core:
        return word, ""
    if not core.isascii() and (max(core) > LAST_LATIN or DOTTED_I in core):
        return word, ""
    return core.lower(), word[len(core):]


def split_words(text: str) -> list[str]:
    """Words between white space as the tokenizer's vocabulary sees it: these four
    separators are white space to Python alone."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return SPACE.findall(text)
    return text.split()


def encoder(path: str, end_id: int) -> Encoder:
    """One for all tasks of a Python worker."""
    return remembered(__name__, (path, end_id), lambda: Encoder(path, end_id))


@dataclass
class Stream:
    """Documents packed together: their ids and the places where cuts may fall."""

    documents: list[tuple[int | None, bytes]]
    places: list[int]
    penalties: list[int]


def with_grid(places: list[int], penalties: list[int], length: int) -> tuple[list[int], list[int]]:
    """Adds places inside stretches longer than ``length`` and before the end."""
    end = places[-1]
    cost = dict(zip(places, penalties))
    for a, b in zip(places, places[1:]):
        if b - a > length // 2:
            for at in range(a + GRID, b, GRID):
                cost.setdefault(at, INSIDE)
    for back in range(GRID, min(length, end - 1) + 1, GRID):
        cost.setdefault(end - back, INSIDE)
    kept = sorted(cost)
    return kept, [cost[x] for x in kept]


def padding(size: int, length: int) -> int:
    return 0 if size & (size - 1) == 0 else length - size


def best_cuts(places: list[int], penalties: list[int], length: int) -> list[int]:
    """Places (first and last included) of the cheapest windows: padding of
    each plus the penalty of its end and the price of a sequence. Windows hold at most ``length`` tokens;
    neighbouring places must not be farther apart."""
    count = len(places)
    best = [0] * count
    came = [0] * count
    powers = [1 << k for k in range(GRID.bit_length() - 1, length.bit_length() - 1)]  # without padding
    index = {0: 0}
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # rising (best + place, number)
    first = 0
    for j in range(1, count):
        end = places[j]
        while places[first] < end - length:
            index.pop(places[first])
            first += 1
        while queue[0][1] < first:
            queue.popleft()
        cost, start = queue[0]
        cost += length - end
        for p in powers:
            i = index.get(end - p)
            if i is not None and best[i] < cost:
                cost, start = best[i], i
        best[j] = cost + penalties[j] + SEQUENCE
        came[j] = start
        index[end] = j
        value = best[j] + end
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts = [count - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return [places[i] for i in reversed(cuts)]


def pieces(documents: list[tuple[int | None, bytes]], cuts: list[int], first_sequence: int) -> Iterator[tuple]:
    """(doc_id, start, ids, doc_tokens, sequence, offset) in order of the stream."""
    window, at = 0, 0  # the window and the place in the stream
    for doc_id, ids in documents:
        total, start = len(ids) >> 2, 0
        while start < total:
            while cuts[window + 1] <= at:
                window += 1
            size = min(total - start, cuts[window + 1] - at)
            yield doc_id, start, ids[start * 4:(start + size) * 4], total, first_sequence + window, at - cuts[window]
            start += size
            at += size


def _packed(stream: Stream, length: int, first_sequence: int) -> tuple[pa.RecordBatch, int]:
    places, penalties = with_grid(stream.places, stream.penalties, length)
    cuts = best_cuts(places, penalties, length)
    ids, starts, parts, totals, sequences, offsets = zip(*pieces(stream.documents, cuts, first_sequence))
    columns = [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary()),
               pa.array(totals, pa.int64()), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]), len(cuts) - 1


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         length: int = LENGTH) -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset): a row per piece of a
    document, with its token ids as little-endian unsigned 32-bit bytes.

    ``tokenizer`` is a file every executor can read. Each partition packs its
    own rows in the order in which they are stored, so nothing is shuffled;
    ``sequence_id`` is unique and rises in that order. Null and empty texts are
    one token, ``end_id``; repeated rows and null ids are packed like any other.
    An empty table gives no pieces."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer, end_id).encode_all
        sequence = TaskContext.get().partitionId() << 32
        stream = Stream([], [0], [DOCUMENT])
        some = (batch.slice(at, DOCS) for batch in batches for at in range(0, batch.num_rows, DOCS))
        for batch in some:
            found = encode_all(batch.column(1).to_pylist())
            for doc_id, (ids, ends) in zip(batch.column(0).to_pylist(), found):
                begin = stream.places[-1]
                total = begin + (len(ids) >> 2)
                last = begin
                for end in ends:
                    if begin + end > last and begin + end + 1 < total:
                        last = begin + end
                        stream.places.append(last)
                        stream.penalties.append(SENTENCE)
                stream.places.append(total)
                stream.penalties.append(DOCUMENT)
                stream.documents.append((doc_id, ids))
                if total >= STREAM:
                    packed, used = _packed(stream, length, sequence)
                    yield packed
                    sequence += used
                    stream = Stream([], [0], [DOCUMENT])
        if stream.documents:
            yield _packed(stream, length, sequence)[0]

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, task, "doc_id bigint, start bigint, ids binary, doc_tokens bigint, "
                                   "sequence_id bigint, offset bigint")


def packed_digest(docs: DataFrame) -> DataFrame:
    """Pieces of at most 4096 tokens with the checksum of their ids."""
    found = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("length"),
                        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark, data_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packed_digest(table(spark, data_dir, "documents"))
