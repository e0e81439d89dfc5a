"""Alignment of the tokens that two tokenizers make of the same text.

Both tokenizations cut the same bytes. Where a token of either side ends at the
same byte, the text is cut into groups; within a group each pair of tokens whose
bytes overlap is a link. Ends are looked up in two dictionaries from end to token
number, and their common keys, sorted, slice both lists of ids.

A space between two other characters that are no white space begins a token on both
sides, so the words it parts are aligned on their own, and a worker remembers
them: a text is put together from what its words gave.

How often a pair of ids is linked in the whole corpus is counted per chunk of
documents first: only a chunk's distinct pairs are shuffled, and they bring the
counts of all chunks back to it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenura.llm.common import byte_items, find_package, map_batches, remembered, table
from tenura.sources.shared import pin

SEGMENT = 1 << 18  # characters of a text whose words are looked up at a time, or somewhat more
TOGETHER = 1 << 20  # bytes of texts whose new words are encoded together
CHUNK = 1 << 22  # bytes of text whose pairs are counted together, or one text
CHUNK_DOCS = 4096
LINKS_HELD = 1 << 20  # of a long text, before equal ones are counted
REMEMBERED = 1 << 26  # bytes of words and what they gave, about, in a Python worker
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: how a byte-level vocabulary of this kind cuts texts before it merges.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_CLASSES = "\u0250"  # below, no library differs in what is a letter, a number or a space


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible
    Latin-1 characters themselves, the rest from U+0100 on in rising order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevelSide:
    """A byte-level vocabulary in a JSON file; special tokens are plain text. Merges
    whose ids rise in their order are done by rank, which is several times
    faster; characters that libraries may class differently go the long way."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet, vocabulary = byte_alphabet(), model["vocab"]
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if all(c in alphabet for c in token):
                self.bytes_of[number] = bytes(alphabet[c] for c in token)
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        letters = [vocabulary[c] for c in alphabet]
        self.by_rank = None
        if merged == sorted(merged) and max(letters) < min(merged, default=1 << 62):
            ranks = {self.bytes_of[i]: i for i in [*letters, *merged]}
            self.by_rank = tiktoken.Encoding("own", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.by_rank and max(text, default="") < KNOWN_CLASSES:
            return self.by_rank.encode_ordinary(" " + text)
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids


class PieceSide:
    """A sentence-piece model with byte fallback, which adds the space itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece reaches over a space, so words can't be encoded on their own")
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text cut at spaces that both sides begin a token with; those are left out."""
    start = 0
    while len(text) - start > size:
        cut = BETWEEN.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.end()
    yield text[start:]


class Words:
    """What words gave, by number: tokens of both sides and groups, groups as text
    with a final ";", and the linked pairs of ids, the B id in the upper half."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.empty((1024, 3), dtype=np.int64)
        self.starts = np.zeros(1025, dtype=np.int64)
        self.pairs = np.empty(4096, dtype=np.int64)
        self.held = 0

    def add(self, words: list[str], counts: np.ndarray, groups: list[str], sizes: np.ndarray, pairs: np.ndarray) -> None:
        """New words with their counts, groups, numbers of pairs, and all these pairs."""
        at, more = len(self.groups), len(words)
        begin = int(self.starts[at])
        while at + more > len(self.counts):
            self.counts = np.concatenate([self.counts, np.empty_like(self.counts)])
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts) - 1, dtype=np.int64)])
        while begin + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.empty_like(self.pairs)])
        self.pairs[begin:begin + len(pairs)] = pairs
        self.starts[at + 1:at + 1 + more] = begin + np.cumsum(sizes)
        self.counts[at:at + more] = counts
        self.groups += groups
        self.number.update(zip(words, range(at, at + more)))
        self.held += 250 * more + sum(map(len, words)) + sum(map(len, groups)) + 8 * len(pairs)

    def linked(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of these words, and how often."""
        some, times = np.unique(numbers, return_counts=True)
        starts, ends = self.starts[some], self.starts[some + 1]
        size = ends - starts
        place = np.arange(size.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return _counted([(self.pairs[place], np.repeat(times, size))])


class Aligner:
    def __init__(self, a: ByteLevelSide, b: PieceSide):
        self.a, self.b = a, b
        self.words = Words()
        self.size_a, self.size_b = (np.array([len(x) for x in s.bytes_of]) for s in (a, b))
        names_a, names_b = ([str(i) for i in range(len(s.bytes_of))] for s in (a, b))
        # The name of an id with what follows it: more of its side, or the end of the side.
        self.names = [mark for names, marks in ((names_a, ",|"), (names_b, ",;"))
                      for sign in marks for mark in (n + sign for n in names)]

    def learn(self, words: set[str]) -> None:
        """Encode what isn't known yet, all as one text but for words that begin or end
        with white space (at the ends of texts)."""
        if self.words.held > REMEMBERED:
            self.words = Words()
        new = [w for w in words if w not in self.words.number]
        plain = [w for w in new if not (w[0].isspace() or w[-1].isspace())]
        single = [w for w in new if w[0].isspace() or w[-1].isspace()]
        if plain and not self._learned(plain):
            single += plain
        for word in single:
            if not self._learned([word]):
                nothing = np.zeros((1, 3), dtype=np.int64)
                self.words.add([word], nothing, [""], nothing[0, :1], nothing[0, :0])

    def _learned(self, new: list[str]) -> bool:
        """False if one side changes the bytes."""
        text = " ".join(new)
        ids_a, ids_b = self.a.encode(text), self.b.encode(text)
        data = b" " + text.encode()
        if b"".join(map(self.a.bytes_of.__getitem__, ids_a)) != data:
            return False
        if b"".join(map(self.b.bytes_of.__getitem__, ids_b)) != data:
            return False
        ends = np.cumsum([len(w.encode()) + 1 for w in new])
        counts, names, sizes, pairs = self.align(np.array(ids_a), np.array(ids_b), ends)
        marks = [0, *np.cumsum(counts[:, 0] + counts[:, 1]).tolist()]
        groups = ["".join(names[x:y]) for x, y in zip(marks, marks[1:])]
        self.words.add(new, counts, groups, sizes, pairs)
        return True

    def align(self, a: np.ndarray, b: np.ndarray, parts: np.ndarray
              ) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Tokens of both sides and groups per part of the bytes (parts end where both
        sides do), the names of all tokens in order of the groups, links per part,
        and the linked pairs."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at_a = dict(zip(ends_a.tolist(), range(len(a))))
        at_b = dict(zip(ends_b.tolist(), range(len(b))))
        common = sorted(at_a.keys() & at_b.keys())
        last_a = np.fromiter(map(at_a.__getitem__, common), np.int64, len(common))
        last_b = np.fromiter(map(at_b.__getitem__, common), np.int64, len(common))
        # Each stretch between neighbouring ends of either side lies in one token of
        # both, and no two stretches in the same two: it is a link.
        ends = np.union1d(ends_a, ends_b)
        pairs = (b[np.searchsorted(ends_b, ends)] << 32) | a[np.searchsorted(ends_a, ends)]
        upto = [np.searchsorted(x, parts, side="right") for x in (ends_a, ends_b, np.array(common), ends)]
        *counts, sizes = (np.diff(x, prepend=0) for x in upto)
        return np.stack(counts, axis=1), self._named(a, b, last_a, last_b), sizes, pairs

    def _named(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """Ids of the slices in order: a token's place is its number plus the
        tokens of the other side in slices before it (and, for B, in its own)."""
        slice_a = np.searchsorted(last_a, np.arange(len(a)))
        slice_b = np.searchsorted(last_b, np.arange(len(b)))
        before_b = np.concatenate(([0], last_b[:-1] + 1))
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        name_a, name_b = a.copy(), b + 2 * len(self.size_a)
        name_a[last_a] += len(self.size_a)
        name_b[last_b] += len(self.size_b)
        codes[np.arange(len(a)) + before_b[slice_a]] = name_a
        codes[np.arange(len(b)) + last_a[slice_b] + 1] = name_b
        return list(map(self.names.__getitem__, codes.tolist()))

    def texts(self, some: list[bytes | None]) -> list[Text]:
        """The alignments of texts whose new words are encoded together."""
        decoded = [_decoded(data) for data in some]
        split = [BETWEEN.split(t) if len(t) <= SEGMENT else None for t in decoded]
        self.learn({w for words in split if words for w in words if w})
        return [Text(self, text, words) for text, words in zip(decoded, split)]


def _decoded(data: bytes | None) -> str:
    """Bytes that are no UTF-8 have no text."""
    try:
        return data.decode() if data else ""
    except UnicodeDecodeError:
        return ""


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their weights in all."""
    values, back = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    weights = np.bincount(back, np.concatenate([w for _, w in parts]), len(values))
    return values, weights.astype(np.int64)


class Text:
    """The alignment of one text; ``words`` are its words if they are known already."""

    def __init__(self, aligner: Aligner, text: str, words: list[str] | None):
        self.clear()
        if not text:
            return
        texts, held, waiting = [], [], 0
        for segment in [words] if words else map(BETWEEN.split, segments(text)):
            if not words:
                aligner.learn(set(segment))
            known = aligner.words
            numbers = np.fromiter(map(known.number.__getitem__, segment), np.int64, len(segment))
            counts = known.counts[numbers]
            if not counts[:, 2].all():  # one side changes the bytes of a word
                self.clear()
                return
            n_a, n_b, n_groups = counts.sum(axis=0).tolist()
            self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups
            self.n_links += int((known.starts[numbers + 1] - known.starts[numbers]).sum())
            texts.append("".join(map(known.groups.__getitem__, numbers.tolist())))
            held.append(known.linked(numbers))
            waiting += len(held[-1][0])
            if waiting > LINKS_HELD:
                held, waiting = [_counted(held)], 0
        self.groups = "".join(texts)[:-1]
        self.pairs, self.times = _counted(held) if len(held) > 1 else held[0]

    def clear(self) -> None:
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.groups = ""
        self.pairs = self.times = np.empty(0, dtype=np.int64)


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return remembered(__name__, (path_a, path_b), lambda: Aligner(ByteLevelSide(path_a), PieceSide(path_b)))


ALIGNED = ("chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
           "places binary, times binary, pairs binary, sums binary")


def _chunk(number: int, ids: list[int | None], texts: list[Text]) -> pa.RecordBatch:
    """Rows of a chunk. Its first row carries the chunk's distinct pairs; each row
    names its own by their places among them."""
    pairs, sums = _counted([(t.pairs, t.times) for t in texts])
    places = [np.searchsorted(pairs, t.pairs).astype("<i4").tobytes() for t in texts]
    rest = [None] * (len(texts) - 1)
    columns = [
        pa.array([number] * len(texts), pa.int64()), pa.array(ids, pa.int64()),
        *(pa.array([getattr(t, c) for t in texts], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
        pa.array([t.groups for t in texts], pa.string()), pa.array(places, pa.binary()),
        pa.array([t.times.astype("<i4").tobytes() for t in texts], pa.binary()),
        pa.array([pairs.astype("<i8").tobytes(), *rest], pa.binary()),
        pa.array([sums.astype("<i8").tobytes(), *rest], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts of about TOGETHER bytes, or one text."""
    ids, some, size = [], [], 0
    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), byte_items(batch.column(1))):
            ids.append(doc_id)
            some.append(data)
            size += len(data or b"")
            if size >= TOGETHER or len(some) == CHUNK_DOCS:
                yield ids, some
                ids, some, size = [], [], 0
    if some:
        yield ids, some


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per text: ``groups`` (as ``a1,a2|b1;a3|b2,b3``: the ids of both sides, by
    group), numbers of tokens, groups and links, and the text's distinct linked pairs
    by chunk (``link_counts`` reads them).

    The files must be readable by every executor. Both sides encode a space and the
    text. A text that is null, empty, not UTF-8, or that one side changes, has no
    tokens: zeros and empty groups. Repeated rows and null ids are rows like any
    other; other columns of ``docs`` are not read. An empty table gives no rows.
    Of a long text only the groups and distinct pairs are held whole."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for some_ids, some in _together(batches):
            ids += some_ids
            texts += found.texts(some)
            size += sum(len(data or b"") for data in some)
            if size >= CHUNK or len(texts) >= CHUNK_DOCS:
                yield _chunk(number, ids, texts)
                number, ids, texts, size = number + 1, [], [], 0
        if texts:
            yield _chunk(number, ids, texts)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, task, ALIGNED)


def _asked(aligned: DataFrame) -> DataFrame:
    """(chunk, place, pair, n) of every chunk's distinct pairs."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, sums in zip(*(batch.column(i).to_pylist() for i in range(3))):
                values = np.frombuffer(pairs, dtype="<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), chunk)), pa.array(np.arange(len(values), dtype=np.int32)),
                     pa.array(values), pa.array(np.frombuffer(sums, dtype="<i8"))], ["chunk", "place", "pair", "n"])

    some = aligned.select("chunk", "pairs", "sums").filter("pairs IS NOT NULL")
    return map_batches(some, task, "chunk bigint, place int, pair bigint, n bigint")


def pair_counts(aligned: DataFrame, name: str = "alignment") -> DataFrame:
    """(pair, count, best): the links of each pair of ids in all texts, and whether
    no other pair with the same B id has more. B's id is in the upper half."""
    counts = pin(_asked(aligned).groupBy("pair").agg(F.sum("n").alias("count")), f"{name}-pairs")
    b = F.shiftright("pair", 32)
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # a row per id of the vocabulary
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_counts(aligned: DataFrame, keep: list[str], name: str = "alignment") -> DataFrame:
    """The ``keep`` columns of the written rows of ``align``, ``n_best`` (links whose
    pair is the most frequent of its B id, ties included) and ``count_sum`` (the
    counts of the pairs of all links). A chunk's counts return to it as a group
    that is no larger than its distinct pairs."""
    find_package(aligned.sparkSession)
    asked = _asked(aligned).drop("n")
    answers = asked.join(pair_counts(aligned, name), "pair").select("chunk", "place", "count", "best")

    def weigh(rows: pa.Table, told: pa.Table) -> pa.Table:
        order = told.column("place").to_numpy()
        count, best = np.zeros((2, len(order)), dtype=np.int64)
        count[order] = told.column("count").to_numpy()
        best[order] = told.column("best").to_numpy()
        sums = []
        for places, times in zip(rows.column("places").to_pylist(), rows.column("times").to_pylist()):
            at, n = np.frombuffer(places, dtype="<i4"), np.frombuffer(times, dtype="<i4").astype(np.int64)
            sums.append((int(best[at] @ n), int(count[at] @ n)))
        found = np.array(sums, dtype=np.int64).T
        return rows.select(keep).append_column("n_best", pa.array(found[0])).append_column(
            "count_sum", pa.array(found[1]))

    rows = aligned.select("chunk", *keep, "places", "times")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.select(*keep).schema.fields)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        weigh, f"{kept}, n_best bigint, count_sum bigint")


def op11_token_alignment(spark, data_dir: str) -> DataFrame:
    """Links between byte-level and piece tokens of every document."""
    found = align(table(spark, data_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                  public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    written = pin(found.select("chunk", *kept[:-1], digest, "places", "times", "pairs", "sums"), "alignment")
    return link_counts(written, kept).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                                             "count_sum", "groups_sha256")
