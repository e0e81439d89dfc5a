import hashlib

import pytest

from tenura.llm import fixity
from tenura.llm.fixity import audit, merkle_levels, op9_warc_fixity, record_hashes, warc_records, with_damage

from ..conftest import DATA

SCHEMA = "archive bigint, record bigint, offset bigint, length bigint, payload binary"


def rows(n, per=40):
    return [(i // per, i, (i % per) * 50_000, 5, f"body{i}".encode()) for i in range(n)]


def status(spark, a, b):
    frames = [spark.createDataFrame(x, SCHEMA) for x in (a, b)]
    return sorted((r.archive, r.offset, r.record, r.status) for r in audit(*frames).collect())


def test_query_equals_sql(spark, duck):
    df = op9_warc_fixity(spark, DATA)
    cursor = duck.execute(fixity.OP9_SQL)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = cursor.fetchall()
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(expected) and expected


def test_every_kind_of_damage(spark):
    good = rows(400)
    bad = list(good)
    bad[7] = (*bad[7][:4], b"other")
    del bad[200]
    bad.append((3, 999, 77, 5, b"new"))
    bad.append((50, 1000, 0, 5, b"archive"))
    assert status(spark, good, bad) == sorted([
        (0, 7 * 50_000, 7, "altered"), (5, 0, 200, "missing"), (3, 77, 999, "extra"), (50, 0, 1000, "extra")])
    assert status(spark, good, good) == [] and status(spark, good, list(reversed(good))) == []


def test_taller_replica_and_lost_archives(spark):
    good = rows(80)
    taller = good + [(1, 500, 900_000_000, 5, b"far")]
    assert status(spark, good, taller) == [(1, 900_000_000, 500, "extra")]
    assert status(spark, good, good[40:]) == [(0, i * 50_000, i, "missing") for i in range(40)]
    assert len(status(spark, good, [])) == 80 and status(spark, [], []) == []


def test_nulls_and_repeats(spark):
    a = [(0, 1, 0, 0, None), (0, 1, 0, 0, None), (-1, None, 0, 3, b"abc")]
    assert status(spark, a, a) == []
    assert status(spark, a, a[1:]) == [(0, 0, 1, "missing")]
    assert status(spark, a, [a[0], (0, 1, 0, 0, b"x"), a[2]]) == [(0, 0, 1, "altered")]


def test_only_damaged_branches_are_read(spark):
    frame = spark.createDataFrame(rows(400), SCHEMA)
    levels = merkle_levels(record_hashes(frame), "test")
    damaged = merkle_levels(record_hashes(with_damage(frame, 399)), "test")
    assert [t.count() for t in levels] == [320, 20, 10] or levels[-1].count() == 10
    changed = fixity._unlike(levels[-1], damaged[-1], ["archive", "span"]).collect()
    assert sorted(r.archive for r in changed) == [0, 9]


def test_records(spark):
    pages = spark.createDataFrame(
        [(1, "http://x", "<p>é"), (None, None, None), (1001, "http://y", ""), (1, "http://x", "<p>é"), (3, "u", "z" * 300_000)],
        "page_id bigint, url string, html string").selectExpr("*", "'n' AS archive", "0 AS offset")
    got = sorted(warc_records(pages).collect(), key=lambda r: (r.archive, r.offset))
    assert [(r.archive, r.record) for r in got] == [(-1, None), (0, 1), (0, 1), (0, 3), (1, 1001)]
    assert all(r.length == len(r.payload) for r in got) and got[2].offset == got[1].length
    head, body = bytes(got[1].payload).split(b"\r\n\r\n", 1)
    assert b"Content-Length: 5" in head and body == "<p>é\r\n\r\n".encode()
    hashes = {r.digest for r in record_hashes(warc_records(pages)).collect()}
    assert hashes == {hashlib.sha256(bytes(r.payload)).hexdigest() for r in got}
    assert warc_records(pages.limit(0)).collect() == []


@pytest.mark.parametrize("every", [3])
def test_damage(spark, every):
    frame = spark.createDataFrame([(0, i, i, 12, b"0123456789ab") for i in range(3)] + [(0, None, 9, 1, b"x")], SCHEMA)
    got = {r.record: bytes(r.payload) for r in with_damage(frame, every).collect()}
    assert got == {0: b"0123456789a#", 2: bytes(8) + b"89ab", None: b"x"}
