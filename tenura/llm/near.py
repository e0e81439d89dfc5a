"""Near-duplicate groups by the similarity of the sets of word shingles.

Candidates share a Golay key of SimHash (see ``simhash``): those whose first fingerprint
words differ in at most three bits all do. One word finds about half of the pairs at 0.8, so
candidates may also share a band of MinHash minima: of 24 bands of four minima, two texts
at similarity s have one in common with probability 1 - (1 - s^4)^24, which is
0.999997 at 0.8. Fingerprints of 768 SimHash bits over the same sets join the
candidates loosely (at 0.8 they differ in about 116 bits, with a standard
deviation of 10); within such a loose group what is linked is decided by the exact
similarity of its sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import byte_items, in_blocks, map_batches, sorted_groups
from tenura.llm.components import connected_components
from tenura.llm.simhash import BLOCK, SEED, fingerprint, golay_keys, name_groups, print_links, shingle_hashes
from tenura.sources.shared import pin

BANDS, ROWS = 24, 4
CHUNK = 1024  # shingles whose minima are taken at a time
SIZE = 12  # words of 64 bits of a fingerprint
LOOSE = 170  # bits; about a similarity of 0.6, and over five deviations above the mean at 0.8
TEXTS = 256  # texts of a loose group in a block
MARKS = 1 << 25  # bits that tell the tasks which texts are asked for
MASKS, FACTORS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
FACTORS |= np.uint64(1)


def text_mark(text_col: str) -> Column:
    """A hash of a text as it stands, which tells rows with one id apart."""
    return F.xxhash64(F.col(text_col))


def node_of(data: bytes) -> int:
    """Number of a text: a hash of its words, lower-cased like its shingles."""
    return xxhash.xxh64_intdigest(b" ".join(data.lower().split()), SEED) - 2**63


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; none for a text without shingles."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, ((hashes[at:at + CHUNK] ^ MASKS) * FACTORS).min(axis=1))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), number) for number, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def _prints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys, verified = [], [], []
            for data in byte_items(batch.column(1)):
                hashes = np.unique(shingle_hashes(data or b"", words))
                nodes.append(node_of(data or b""))
                keys.append(band_keys(hashes).tobytes())
                verified.append(fingerprint(hashes, SIZE).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(keys, pa.binary()), pa.array(verified, pa.binary()),
                 batch.column(2)], ["id", "node", "keys", "verified", "mark"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"),
                       text_mark(text_col).alias("mark"))
    return map_batches(rows, task, "id bigint, node bigint, keys binary, verified binary, mark bigint")


def _keyed(nodes: DataFrame) -> DataFrame:
    """A row for each key of a node: the bands, and the Golay keys of the first word of
    its fingerprint."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                keys = [np.frombuffer(k, dtype=np.int64) for k in some.column(1).to_pylist()]
                prints = np.frombuffer(b"".join(some.column(2).to_pylist()), dtype="<u8").reshape(-1, SIZE)
                rows, golay = golay_keys(prints[:, :1])
                take = pa.array(np.concatenate([np.repeat(np.arange(len(keys)), list(map(len, keys))), rows]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([*keys, golay])), some.column(0).take(take), some.column(2).take(take)],
                    ["key", "node", "verified"])

    return map_batches(nodes.select("node", "keys", "verified"), task, "key bigint, node bigint, verified binary")


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def exact_spanning(sets: list[np.ndarray], prints: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Tree edges (member, root) of the components that pairs of sets of ``similarity``
    and more make; pairs that are joined already, or loosely unlike, aren't compared."""
    sizes = np.array([len(x) for x in sets])
    label, edges = np.full(len(sets), -1), []
    for root in range(len(sets)):
        if label[root] >= 0:
            continue
        label[root], front = root, [root]
        while front:
            x = front.pop()
            may = np.flatnonzero((label < 0) & (np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x]) - 1e-9))
            may = may[np.bitwise_count(prints[may] ^ prints[x]).sum(axis=1) <= LOOSE]
            for y in may.tolist():
                if _alike(sets[x], sets[y], similarity):
                    label[y] = root
                    edges.append((y, root))
                    front.append(y)
    return edges


def _confirmed(dealt: DataFrame, words: int, similarity: float, keys: list[str]) -> DataFrame:
    """Tree edges (a, b) over the exact links in each group."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, spans in sorted_groups(batches, keys):
            nodes, edges = rows.column("node").to_numpy(), []
            for start, end in spans:
                some = rows.slice(start, end - start)
                sets, prints = _sets(some, words)
                edges += [(nodes[start + x], nodes[start + y]) for x, y in exact_spanning(sets, prints, similarity)]
            if edges:
                yield _edge_batch(edges)

    return map_batches(dealt.select(*keys, "node", "verified", "text"), task, "a bigint, b bigint")


def _sets(rows: pa.Table, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    sets = [np.unique(shingle_hashes(t.as_py() or b"", words)) for t in rows.column("text")]
    return sets, np.frombuffer(b"".join(rows.column("verified").to_pylist()), dtype="<u8").reshape(-1, SIZE)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(edges, dtype=np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _visited(dealt: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) between the guests of each block and its rows of other components,
    one for each guest and component."""
    keys = ["key", "block"]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, spans in sorted_groups(batches, keys):
            nodes, edges = rows.column("node").to_numpy(), []
            own, guest = rows.column("own").to_numpy(), rows.column("guest").to_numpy(zero_copy_only=False)
            for start, end in spans:
                some = rows.slice(start, end - start)
                sets, prints = _sets(some, words)
                sizes = np.array([len(x) for x in sets])
                for x in np.flatnonzero(guest[start:end]).tolist():
                    may = np.flatnonzero(own[start:end] != own[start + x])
                    may = may[np.minimum(sizes[may], sizes[x]) >= similarity * np.maximum(sizes[may], sizes[x]) - 1e-9]
                    may = may[np.bitwise_count(prints[may] ^ prints[x]).sum(axis=1) <= LOOSE]
                    linked = set()
                    for y in may.tolist():
                        if own[start + y] not in linked and _alike(sets[x], sets[y], similarity):
                            linked.add(own[start + y])
                            edges.append((nodes[start + x], nodes[start + y]))
            if edges:
                yield _edge_batch(edges)

    return map_batches(dealt.select(*keys, "node", "own", "guest", "verified", "text"), task, "a bigint, b bigint")


def exact_edges(held: DataFrame, words: int, similarity: float, name: str) -> DataFrame:
    """Edges (a, b) that join what exact links join in each loose group (``key``) of
    ``held`` (key, node, verified, text), a written table.

    First the rows of a block of TEXTS are compared, each block on its own; then
    one row of each component so found with those of other blocks; then, where
    a group still has several components, all rows outside its largest one (the
    guests) with every block. So the texts of a large group of copies travel
    once, and no pair of rows in different components is left out."""
    sizes = held.groupBy("key").count().filter(F.col("count") > TEXTS)
    blocks = F.coalesce(F.ceil(F.col("count") / TEXTS), F.lit(1)).cast("int")
    part = F.pmod(F.xxhash64("node"), blocks).cast("int")
    large = pin(sizes, f"{name}-large-loose")
    own = held.join(large, "key", "left").withColumn("block", part).drop("count")
    keys = ["key", "block"]
    edges = pin(_confirmed(own.repartition(*keys).sortWithinPartitions(*keys), words, similarity, keys), f"{name}-in-blocks")
    if large.isEmpty():
        return edges
    wide = held.join(large, "key").drop("count")
    first = _named(wide, edges, f"{name}-first").filter("node = own").drop("own")
    dealt = in_blocks(first, ["key"], "node", TEXTS, f"{name}-large-first")
    between = _confirmed(dealt, words, similarity, ["key", "left", "right"])
    edges = pin(edges.union(between), f"{name}-between")
    named = pin(_named(wide, edges, f"{name}-second").select("key", "node", "own"), f"{name}-named-blocks")
    counts = named.groupBy("key", "own").count()
    largest = counts.groupBy("key").agg(F.max(F.struct("count", "own")).alias("most"), F.count(F.lit(1)).alias("n"))
    split = largest.filter("n > 1").select("key", F.col("most.own").alias("home"))
    rows = wide.join(named, ["key", "node"]).join(split, "key").join(large, "key")
    rows = rows.withColumn("guest", F.col("own") != F.col("home")).withColumn("block", part)
    every = F.sequence(F.lit(0), blocks - 1)
    rows = rows.withColumn("block", F.explode(F.when(F.col("guest"), every).otherwise(F.array("block"))))
    visits = _visited(rows.repartition(*keys).sortWithinPartitions(*keys), words, similarity)
    return pin(edges.union(visits), f"{name}-links")


def _named(rows: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The rows with the component (``own``) of their node."""
    roots = connected_components(edges, name).select(F.col("id").alias("node"), "component")
    return rows.join(roots, "node", "left").withColumn("own", F.coalesce("component", "node")).drop("component")


def _marks(nodes: DataFrame) -> np.ndarray:
    """Bits of a table of MARKS places, of a size that doesn't depend on the data: the
    places that the nodes' numbers fall on are set."""
    place = F.pmod("node", F.lit(MARKS))
    rows = nodes.groupBy(F.shiftright(place, 15).alias("row")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits")).collect()
    bits = np.zeros(MARKS // 8, dtype=np.uint8)
    for row, some in rows:
        bits[row * 4096:(row + 1) * 4096] = np.frombuffer(some, dtype=np.uint8)
    return bits


def _texts(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, text) of these nodes, and of some others that their marks let pass; one
    row per node. Other texts aren't shuffled."""
    bits = _marks(nodes)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.array([node_of(data or b"") for data in byte_items(batch.column(0))], dtype=np.int64)
            place = numbers % MARKS
            keep = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[keep]), batch.column(0).take(pa.array(keep))], ["node", "text"])

    rows = map_batches(docs.select(F.col(text_col).cast("binary").alias("text")), task, "node bigint, text binary")
    return rows.groupBy("node").agg(F.first("text").alias("text"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                similarity: float = 0.8, name: str = "near") -> DataFrame:
    """(id, component_id) of every row of ``docs``; see ``near_members``."""
    return near_members(docs, id_col, text_col, words, similarity, name).select("id", "component_id")


def near_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                 similarity: float = 0.8, name: str = "near") -> DataFrame:
    """(id, component_id, root, mark) of every row of ``docs``; ``root`` is a number of
    the group, and ``mark`` that of the row's text (``text_mark``).

    Texts are linked if the sets of their shingles of ``words`` words are alike by
    ``similarity`` and more; ``component_id`` is the smallest id reachable over
    links, null if no row of the group has one. Every link is exact; a link at 0.8
    is missed with probability 3e-6 by the bands. Copies collapse to one node
    first; texts without words are one node. Large buckets are cut into blocks, and
    each gives a spanning tree of its links; of loose groups see ``exact_edges``."""
    prints = pin(_prints(docs, id_col, text_col, words), f"{name}-prints")
    nodes = prints.groupBy("node").agg(F.first("keys").alias("keys"), F.first("verified").alias("verified"),
                                       F.min("id").alias("smallest"))
    nodes = pin(nodes, f"{name}-nodes")
    dealt = in_blocks(_keyed(nodes), ["key"], "node", BLOCK, f"{name}-large")
    likely = pin(print_links(dealt, SIZE, LOOSE), f"{name}-likely")
    hanging = connected_components(likely, f"{name}-loose").select(F.col("id").alias("node"), "component")
    loose = pin(hanging.union(hanging.select("component", "component").distinct()), f"{name}-hanging")  # with the roots
    held = nodes.select("node", "verified").join(loose, "node").join(_texts(docs, text_col, loose), "node")
    held = pin(held.select(F.col("component").alias("key"), "node", "verified", "text"), f"{name}-texts")
    edges = exact_edges(held, words, similarity, name)
    return name_groups(prints.select("id", "node", "mark"), nodes, edges, name).select("id", "component_id", "root", "mark")
