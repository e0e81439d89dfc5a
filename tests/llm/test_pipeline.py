import pytest

import corpus_pipeline
from tenura.llm.queries import build_oracles, build_queries

from ..conftest import DATA
from .test_packing import check, plain_ids


@pytest.fixture(scope="module")
def stages(spark):
    from tenura.sources.shared import pin
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = pin(stage(spark, docs, DATA), f"test-{name}")
        out.append(docs)
    return out


def test_columns(spark, stages):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").dtypes
    assert all(df.dtypes == schema for df in stages[:-1]) and len(stages) == 5


def test_quality_keeps_good_and_drops_bad(spark, stages):
    kept = {r.doc_id for r in stages[0].collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    good, bad = ([r.doc_id in kept for r in labels if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_one_of_each_group_stays(stages):
    def shingles(text):
        words = (text or "").lower().split()
        return frozenset(zip(*(words[i:] for i in range(5)))) or frozenset([tuple(words)])
    before = {r.doc_id: shingles(r.text) for r in stages[0].collect()}
    after = {r.doc_id for r in stages[1].collect()}
    assert after <= set(before)
    for gone in set(before) - after:
        assert max(similar(before[gone], s) for i, s in before.items() if i != gone) > 0.7
    kept = sorted(after)
    assert not any(similar(before[a], before[b]) > 0.9 for n, a in enumerate(kept) for b in kept[n + 1:])


def test_later_stages(stages):
    first, second, third = ({r.doc_id: r for r in df.collect()} for df in stages[1:4])
    assert set(first) == set(second) == set(third)
    assert all(r.n_chars == len(r.text) for r in second.values()) and any(first[i].text != r.text for i, r in second.items())
    assert all(third[i].text == r.text for i, r in second.items())


def test_run_packs_what_the_stages_keep(spark, stages):
    rows = stages[3].collect()
    ids = plain_ids([r.text for r in rows])
    found = corpus_pipeline.run(spark, DATA).collect()
    assert sum(p.length for p in found) == sum(map(len, ids)) and {p.doc_id for p in found} == {r.doc_id for r in rows}
    assert {p.doc_id: p.doc_tokens for p in found} == {r.doc_id: len(i) for r, i in zip(rows, ids)}


def test_empty_documents(spark, stages):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).collect() == [], name


def test_odd_documents_pass_every_stage(spark, stages):
    first = stages[0].filter("length(text) > 200").limit(3).collect()
    odd = [(None, None, None, None, None), (None, first[0].text, "en", None, 5), (-3, "", "en", "s", 0), (-3, "", "en", "s", 0)]
    docs = spark.createDataFrame(odd + [tuple(r) for r in first] * 2, stages[0].schema)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, DATA)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, stages[0].schema)
        assert {r.doc_id for r in rows} == {None, -3, *(r.doc_id for r in first)}, name
    assert len(rows) >= 6
    assert {p.doc_id for p in corpus_pipeline.pack_sequences(spark, docs, DATA).collect()} == {r.doc_id for r in rows}


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in build_queries())
    assert numbers == list(range(1, 14)) and set(build_oracles()) <= set(build_queries())
