"""Fixity audit of WARC archives by Merkle trees over ordered offset ranges.

A replica is a table of records with archive, offset and payload. Each record
is hashed; the hashes of the records that begin in one range of offsets make a
leaf, and ``FANOUT`` neighbouring ranges make the range above, up to one root per
archive and one over all archives. Two replicas compare their roots and descend
only into the ranges that differ, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.llm.common import table
from tenura.sources.shared import pin

FANOUT = 16
RANGE = 1 << 16  # bytes of archive in a leaf
PER_ARCHIVE = 1000  # records written to one archive
DATE = "2024-01-01T00:00:00Z"


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                 per_archive: int = PER_ARCHIVE) -> DataFrame:
    """(archive, record, offset, length, payload): pages as WARC/1.1 resource
    records, placed one after the other by id in archives of ``per_archive`` ids.

    Null urls and bodies are empty. Rows without id go to archive -1, placed by
    their content; repeated ids follow each other, so every row is a record. The
    window over an archive sees at most ``per_archive`` ids; many repeats of one id
    make that archive longer."""
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    url = F.coalesce(F.col(url_col), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    payload = F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))
    archive = F.coalesce(F.floor(F.col(id_col) / per_archive), F.lit(-1)).cast("bigint")
    rows = pages.select(archive.alias("archive"), F.col(id_col).cast("bigint").alias("record"), payload.alias("payload"))
    rows = rows.withColumn("length", F.octet_length("payload").cast("bigint"))
    order = Window.partitionBy("archive").orderBy("record", F.sha2("payload", 256))
    offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", F.coalesce(offset, F.lit(0))).select("archive", "record", "offset", "length", "payload")


def record_hashes(records: DataFrame) -> DataFrame:
    """(archive, offset, length, record, digest): SHA-256 of every record. A null
    payload has the digest of no bytes."""
    digest = F.sha2(F.coalesce("payload", F.lit("").cast("binary")), 256)
    return records.select("archive", "offset", "length", "record", digest.alias("digest"))


def _span(level: int, offset: Column) -> Column:
    """Number of the range of a level; level 0 are the leaves."""
    return F.floor(offset / (RANGE * FANOUT**level)).cast("bigint")


def _joined(parts: Column) -> Column:
    """Hash over the ordered (place, hash) pairs below a node. A node has at
    most ``FANOUT`` children, a leaf the records that begin in its range."""
    texts = F.transform(F.array_sort(F.collect_list(parts)), lambda p: F.concat_ws(":", p["place"].cast("string"), p["hash"]))
    return F.sha2(F.array_join(texts, ","), 256)


def _pair(place: str, digest: Column) -> Column:
    return F.struct(F.col(place).alias("place"), digest.alias("hash"))


def _above(nodes: DataFrame) -> DataFrame:
    """The next level over spans of an archive."""
    up = nodes.groupBy("archive", F.floor(F.col("span") / FANOUT).cast("bigint").alias("up"))
    return up.agg(_joined(_pair("span", F.col("digest"))).alias("digest")).withColumnRenamed("up", "span")


def merkle_levels(hashes: DataFrame, name: str) -> list[DataFrame]:
    """Node tables (archive, span, digest) from the leaves up to one node per
    archive. Every level is written once."""
    leaf = hashes.groupBy("archive", _span(0, F.col("offset")).alias("span"))
    record = _pair("offset", F.concat_ws(":", F.col("length").cast("string"), "digest"))
    levels = [pin(leaf.agg(_joined(record).alias("digest")), f"{name}-0")]
    while levels[-1].agg(F.max("span")).first()[0]:
        levels.append(pin(_above(levels[-1]), f"{name}-{len(levels)}"))
    return levels


def archive_levels(top: DataFrame, name: str) -> list[DataFrame]:
    """(node, digest) tables over archives, in groups of ``FANOUT``, up to one root
    (two, if there are archive numbers on both sides of zero)."""
    levels = [top.select(F.col("archive").alias("node"), "digest")]
    ends, last = tuple(top.agg(F.min("archive"), F.max("archive")).first()), None
    while ends != last and ends[0] != ends[1]:
        up = levels[-1].groupBy(F.floor(F.col("node") / FANOUT).cast("bigint").alias("up"))
        up = up.agg(_joined(_pair("node", F.col("digest"))).alias("digest"))
        levels.append(pin(up.withColumnRenamed("up", "node"), f"{name}-a{len(levels)}"))
        ends, last = (ends[0] // FANOUT, ends[1] // FANOUT), ends
    return levels


def _unlike(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that one side alone has."""
    other = b.select(*keys, F.col("digest").alias("other"))
    return a.join(other, keys, "full").filter(~F.col("digest").eqNullSafe(F.col("other"))).select(*keys)


def _below(nodes: DataFrame, parents: DataFrame, keys: list[str], parent: list[Column]) -> DataFrame:
    """Nodes whose parent is among ``parents``."""
    names = [f"__p{i}" for i in range(len(keys))]
    left = nodes.withColumns(dict(zip(names, parent)))
    right = parents.select(*(F.col(k).alias(n) for k, n in zip(keys, names)))
    return left.join(right, names, "left_semi").drop(*names)


def audit(first: DataFrame, second: DataFrame, name: str = "fixity") -> DataFrame:
    """(archive, offset, record, length, other_length, digest, other_digest, status)
    of every record that isn't the same in both replicas at its offset.

    ``status`` is ``altered`` (other bytes), ``missing`` (only in the first replica)
    or ``extra`` (only in the second). Equal replicas give no rows, whatever their
    size, after the comparison of two roots. Records repeated at one offset are
    compared as a whole and reported by row."""
    sides = [pin(record_hashes(r), f"{name}-{i}-records") for i, r in enumerate((first, second))]
    trees = [merkle_levels(h, f"{name}-{i}") for i, h in enumerate(sides)]
    height = max(map(len, trees))
    for i, tree in enumerate(trees):  # a longer replica has a taller tree
        while len(tree) < height:
            tree.append(pin(_above(tree[-1]), f"{name}-{i}-{len(tree)}"))
    above = [archive_levels(t[-1], f"{name}-{i}") for i, t in enumerate(trees)]
    depth = min(map(len, above))
    found = pin(_unlike(above[0][depth - 1], above[1][depth - 1], ["node"]), f"{name}-roots")
    for level in range(depth - 2, -1, -1):
        if found.isEmpty():
            break
        a, b = (_below(t[level], found, ["node"], [F.floor(F.col("node") / FANOUT).cast("bigint")]) for t in above)
        found = pin(_unlike(a, b, ["node"]), f"{name}-archives-{level}")
    bad = found.select(F.col("node").alias("archive"), F.lit(0).cast("bigint").alias("span"))
    for level in range(height - 2, -1, -1):
        if bad.isEmpty():
            break
        up = [F.col("archive"), F.floor(F.col("span") / FANOUT).cast("bigint")]
        a, b = (_below(t[level], bad, ["archive", "span"], up) for t in trees)
        bad = pin(_unlike(a, b, ["archive", "span"]), f"{name}-spans-{level}")
    span = [F.col("archive"), _span(0, F.col("offset"))]
    a, b = (_below(h, bad, ["archive", "span"], span) for h in sides)
    rows = a.withColumn("side", F.lit(0)).union(b.withColumn("side", F.lit(1)))
    left, right = (lambda c, s=s: F.max(F.when(F.col("side") == s, F.col(c))) for s in (0, 1))
    pairs = rows.withColumn("turn", F.row_number().over(
        Window.partitionBy("archive", "offset", "side").orderBy("digest", "length", "record")))
    joined = pairs.groupBy("archive", "offset", "turn").agg(
        F.coalesce(left("record"), right("record")).alias("record"), left("length").alias("length"),
        right("length").alias("other_length"), left("digest").alias("digest"), right("digest").alias("other_digest"))
    status = F.when(F.col("other_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("altered")
    return (
        joined.filter(~F.col("digest").eqNullSafe(F.col("other_digest"))).withColumn("status", status)
        .select("archive", "offset", "record", "length", "other_length", "digest", "other_digest", "status")
    )


def with_damage(records: DataFrame, every: int = 97) -> DataFrame:
    """A replica after storage faults, chosen by the record id modulo ``every``: 0
    has its last byte overwritten, 1 is lost, 2 has its first eight bytes zeroed.
    The other bytes and all offsets stay. Records without id are spared."""
    kind = F.coalesce(F.pmod("record", F.lit(every)), F.lit(-1))
    last = F.concat(F.expr("substring(payload, 1, octet_length(payload) - 1)"), F.lit("#").cast("binary"))
    head = F.concat(F.lit(bytes(8)), F.expr("substring(payload, 9)"))
    payload = F.when(kind == 0, last).when(kind == 2, head).otherwise(F.col("payload"))
    return records.withColumn("payload", payload).filter(kind != 1)


def op9_warc_fixity(spark, data_dir: str) -> DataFrame:
    """All pages as WARC records against a damaged replica: every damaged record."""
    records = pin(warc_records(table(spark, data_dir, "pages")), "warc")
    return audit(records, with_damage(records))


OP9_SQL = f"""
WITH body AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
           || 'WARC-Target-URI: ' || COALESCE(url, '') || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10)
           || 'WARC-Record-ID: <urn:page:' || COALESCE(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
           || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
           || octet_length(encode(COALESCE(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
           || COALESCE(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload
  FROM pages
), placed AS (
  SELECT COALESCE(CAST(floor(page_id / {PER_ARCHIVE}.0) AS BIGINT), -1) AS archive, page_id AS record, payload,
         CAST(octet_length(encode(payload)) AS BIGINT) AS length, sha256(encode(payload)) AS digest
  FROM body
), records AS (
  SELECT *, CAST(COALESCE(SUM(length) OVER (PARTITION BY archive ORDER BY record, digest
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM placed
)
SELECT archive, "offset", record, length, CASE WHEN record % 97 <> 1 THEN length END AS other_length, digest,
       CASE record % 97 WHEN 0 THEN sha256(encode(substr(payload, 1, length(payload) - 1) || '#'))
                        WHEN 2 THEN sha256(encode(repeat(chr(0), 8) || substr(payload, 9))) END AS other_digest,
       CASE record % 97 WHEN 1 THEN 'missing' ELSE 'altered' END AS status
FROM records WHERE record % 97 IN (0, 1, 2)
"""
