import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tenura.llm.packing import SEQUENCE, Encoder, best_cuts, op8_packing, pack, padding, with_grid

from ..conftest import DATA

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(texts):
    found = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids + [2] for e in found]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed):
    rng = random.Random(seed)
    length = 256
    places = [0]
    while len(places) < 60:
        places.append(places[-1] + rng.choice([1, 7, 30, 64, 100, 128, 200, 256]))
    penalties = [rng.choice([0, 4, 64]) for _ in places]
    best = [0] + [10**9] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            size = places[j] - places[i]
            # Powers of two below the grid count as padded.
            pad = length - size if size < 64 else padding(size, length)
            if size <= length:
                best[j] = min(best[j], best[i] + pad + penalties[j] + SEQUENCE)
    cuts = best_cuts(places, penalties, length)
    cost = dict(zip(places, penalties))
    total = sum((length - (b - a) if b - a < 64 else padding(b - a, length)) + cost[b] + SEQUENCE for a, b in zip(cuts, cuts[1:]))
    assert total == best[-1] and cuts[0] == 0 and cuts[-1] == places[-1]


def test_grid_fills_long_gaps():
    places, _ = with_grid([0, 10_000, 10_001], [0, 0, 0], 4096)
    assert max(b - a for a, b in zip(places, places[1:])) <= 64
    assert with_grid([0, 1], [0, 0], 4096) == ([0, 1], [0, 0])


@pytest.mark.parametrize("text", [
    "", None, "Plain words, it's fine.", "tabs\tand\nlines\r\n  x", "é́ ÀÉ ΑΣ İstanbul ß", "a\x1cb\x1db\x85c\xa0d e​f", "<|endoftext|> x<|startoftext|>y",
    "1234 5.6e7 ***$$$&&& 日本語テキスト 🙂🙂", "don't we'LL 'tis ''s",
])
def test_words_encode_like_whole_texts(text):
    ids, _ = Encoder(PATH, 2).encode(text)
    assert np.frombuffer(ids, dtype="<u4").tolist() == plain_ids([text])[0]


def test_sentence_ends():
    ids, ends = Encoder(PATH, 2).encode('One two. Three "four?" five')
    assert len(ends) == 2 and ends[1] < len(ids) // 4 - 1


def check(pieces, documents):
    """Pieces cover each (id, ids) document once, sequences have no gap."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for doc_id, ids in documents:
        at = 0
        for p in sorted(by_doc.pop(doc_id), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc
    used = padded = 0
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 4096
        used, padded = used + end, padded + padding(end, 4096)
    return padded / used


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    share = check(op8_packing(spark, DATA).collect(), list(zip([d.doc_id for d in docs], plain_ids([d.text for d in docs]))))
    assert share < 0.02


def test_edges(spark):
    long = "word " * 30_000 + "x" * 30_000
    df = spark.createDataFrame([(1, "a b", 1), (2, None, 1), (3, "", 1), (4, long, 1)], "doc_id bigint, text string, offset int")
    from pyspark.sql import functions as F
    found = pack(df, PATH, 2).withColumn("length", (F.length("ids") / 4).cast("bigint")).withColumn("ids_crc32", F.crc32("ids"))
    check(found.collect(), list(zip([1, 2, 3, 4], plain_ids(["a b", None, "", long]))))
    same = pack(spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "c")], "doc_id bigint, text string").coalesce(1), PATH, 2).collect()
    assert [(p.doc_id, p.offset) for p in same] == [(7, 0), (7, 3), (None, 6)] and len({p.sequence_id for p in same}) == 1
    assert pack(df.limit(0), PATH, 2).collect() == []


def test_every_word_of_the_documents_encodes_like_alone(spark):
    encoder = Encoder(PATH, 2)
    words = {w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for w in r.text.split()}
    words |= {"İ.", "ΑΣ.", "<|ENDOFTEXT|>.", "<|endoftext|>!", "x<|endoftext|>", "...", "it's.", "a'S,", "'re!", "5.", "½,", "ǅ.", "ß!", "\".", "x\".", "ﬁ.", "Å.", "日本."}
    found = encoder.encode_all(sorted(words))
    assert [np.frombuffer(ids, dtype="<u4").tolist() for ids, _ in found] == plain_ids(sorted(words))
