"""Near-duplicate groups by SimHash with Golay-code keys.

Each fingerprint word of 64 bits is cut into three segments of 22, 21 and 21
bits. Two words that differ in at most three bits have at most one error in
two of the segments at least, so the nearest-codeword indices (one to six each,
see ``golay``) of some pair of segments agree in both. Each combination of two
indices is a key; fingerprints that share a key are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm import golay
from tenura.llm.common import byte_items, in_blocks, map_batches, sorted_groups, spanning
from tenura.llm.components import connected_components
from tenura.sources.shared import pin

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and length
CHUNK = 8 * 255  # shingles counted at a time
BLOCK = 512  # fingerprints of a bucket in a block


@dataclass(frozen=True)
class Print:
    """A fingerprint: shingles of ``words`` words, ``size`` words of 64 bits."""

    words: int = 3
    size: int = 1


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a UTF-8 text, repeats included.

    A to Z are lower-cased; words are runs of bytes other than ASCII white
    space. A text with fewer words is one shingle, one without words has none.
    """
    split = data.lower().split()
    if not split:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(split)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)))
    first, last = starts[: len(split) - words + 1], starts[words:] - 1
    hashes = (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist()))
    return np.fromiter(hashes, dtype=np.uint64, count=len(first))


def _scattered(hashes: np.ndarray, number: int) -> np.ndarray:
    """Another 64-bit hash of each hash; the hash itself for number 0."""
    if number == 0:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * number % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, size: int = 1) -> np.ndarray:
    """Each bit is set if it is set in over half of the hashes; zero for none."""
    out = np.zeros(size, dtype=np.uint64)
    for number in range(size):
        votes = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), CHUNK):
            some = _scattered(hashes[at:at + CHUNK], number)
            bits = np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, 64)
            full = len(bits) // 255 * 255
            # 255 rows of 0 and 1 add up in bytes, eight of them in one integer.
            lanes = bits[:full].view(np.uint64).reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
            votes += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            votes += bits[full:].sum(axis=0, dtype=np.int64)
        set_bits = (2 * votes > len(hashes)).astype(np.uint8)
        out[number] = np.packbits(set_bits, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, find: Print, verify: Print) -> DataFrame:
    """(id, first, found, verified): the first word of the found fingerprint, and
    the words of both as little-endian bytes."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, verified = [], []
            for data in byte_items(batch.column(1)):
                hashes = shingle_hashes(data or b"", find.words)
                found.append(fingerprint(hashes, find.size).tobytes())
                if verify == find:
                    verified.append(found[-1])
                else:
                    hashes = shingle_hashes(data or b"", verify.words)
                    verified.append(fingerprint(hashes, verify.size).tobytes())
            first = np.array([int.from_bytes(x[:8], "little", signed=True) for x in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first), pa.array(found, pa.binary()), pa.array(verified, pa.binary())],
                ["id", "first", "found", "verified"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, task, "id bigint, first bigint, found binary, verified binary")


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprint words (rows, size): number of word and
    of segment pair above the two codeword indices of 12 bits."""
    rows, keys = [], []
    for number in range(words.shape[1]):
        near = [golay.nearest((words[:, number] >> np.uint64(a)) & np.uint64((1 << n) - 1)) for a, n in SEGMENTS]
        for pair, (x, y) in enumerate(combinations(range(3), 2)):
            (kx, nx), (ky, ny) = near[x], near[y]
            for i in range(golay.KEYS):
                for j in range(golay.KEYS):
                    have = np.flatnonzero((i < nx) & (j < ny))
                    rows.append(have)
                    keys.append(((number * 3 + pair) << 24) | (kx[have, i].astype(np.int64) << 12) | ky[have, j])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(prints: DataFrame, size: int) -> DataFrame:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                words = np.frombuffer(b"".join(some.column(1).to_pylist()), dtype="<u8").reshape(-1, size)
                rows, keys = golay_keys(words)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), some.column(0).take(take), some.column(2).take(take)],
                    ["key", "node", "verified"])

    return map_batches(prints.select("node", "found", "verified"), task, "key bigint, node bigint, verified binary")


def print_links(dealt: DataFrame, size: int, max_distance: int) -> DataFrame:
    """Tree edges (a, b) over the links in each group: at most one per row."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, spans in sorted_groups(batches, ["key", "left", "right"]):
            nodes = rows.column("node").to_numpy()
            prints = np.frombuffer(b"".join(rows.column("verified").to_pylist()), dtype="<u8").reshape(-1, size)
            edges = []
            for start, end in spans:
                some = prints[start:end]
                apart = np.zeros((len(some), len(some)), dtype=np.int16)
                for word in range(size):
                    apart += np.bitwise_count(some[:, word, None] ^ some[None, :, word])
                links = apart <= max_distance
                np.fill_diagonal(links, False)
                edges += [(nodes[start + x], nodes[start + y]) for x, y in spanning(links)]
            if edges:
                a, b = np.array(edges, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return map_batches(dealt.drop("part"), task, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   find: Print = Print(), verify: Print | None = None, max_distance: int = 3,
                   name: str = "simhash") -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    ``fingerprint`` is the first word of the ``find`` fingerprint in hex;
    ``component_id`` the smallest id reachable over links. Rows are linked if
    their ``verify`` fingerprints (by default the same) differ in at most
    ``max_distance`` bits. With one word and a distance up to three, every link is
    found; with another verify fingerprint, those that share a key.

    Copies collapse to one fingerprint before anything is compared, large
    buckets are cut into blocks, and each group gives a spanning tree of its
    links instead of all pairs. Null and empty texts have fingerprint zero and
    link like any other; a row without id keeps its fingerprint and gets the
    smallest id of its component, null if there is none. Other columns are
    ignored; an empty table gives an empty result.
    """
    verify = verify or find
    prints = pin(fingerprints(docs, id_col, text_col, find, verify), f"{name}-prints")
    # A fingerprint's node number: its own bits, or a hash where it is longer.
    node = F.col("first") if find.size == 1 and verify == find else F.xxhash64("found", "verified")
    prints = prints.withColumn("node", node)
    nodes = prints.groupBy("node").agg(F.first("found").alias("found"), F.first("verified").alias("verified"),
                                       F.min("id").alias("smallest"))
    nodes = pin(nodes, f"{name}-nodes")
    dealt = in_blocks(_keyed(nodes, find.size), ["key"], "node", BLOCK, f"{name}-large")
    edges = pin(print_links(dealt, verify.size, max_distance), f"{name}-links")
    return name_groups(prints, nodes, edges, name).select(
        "id", F.lpad(F.lower(F.hex("first")), 16, "0").alias("fingerprint"), "component_id")


def name_groups(prints: DataFrame, nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``prints`` with the component_id of each row, the smallest id of all nodes that
    ``edges`` join, and their root."""
    roots = connected_components(edges, f"{name}-components")
    member = nodes.select("node", "smallest").join(roots, F.col("node") == F.col("id"), "left")
    member = pin(member.select("node", "smallest", F.coalesce("component", "node").alias("root")), f"{name}-roots")
    smallest = member.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = pin(member.join(smallest, "root").select("node", "component_id", "root"), f"{name}-named")
    return prints.join(named, "node")


def op1_simhash_dedup(spark, data_dir: str) -> DataFrame:
    """doc_id, fingerprint and component of every document: three-word
    shingles, links at three or fewer differing bits."""
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    return simhash_groups(docs).withColumnRenamed("id", "doc_id")
