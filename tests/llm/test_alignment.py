import random
from collections import Counter
from hashlib import sha256

import pytest
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenura.llm import alignment
from tenura.sources.shared import pin

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    """Both tokenizations of a whole text, token by token, with byte ranges; groups
    and links by their definitions."""
    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    sb = sentencepiece.SentencePieceProcessor(model_file=B)
    decode = alignment.byte_alphabet()

    def ranges(parts):
        out, at = [], 0
        for number, data in parts:
            out.append((number, at, at + len(data)))
            at += len(data)
        return out

    def run(text):
        if not text:
            return None
        whole = (" " + text).encode()
        a = [(i, bytes(decode[c] for c in ta.id_to_token(i))) for i in ta.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(sb.id_to_piece(i)[3:5], 16)]) if sb.is_byte(i) else
              sb.id_to_piece(i).replace("▁", " ").encode()) for i in sb.encode(text)]
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return None
        a, b = ranges(a), ranges(b)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for end in ends:
            inside = [",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)]
            groups.append("|".join(inside))
            start = end
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        return len(a), len(b), ";".join(groups), links

    return run


def expected(brute, rows):
    found = [brute(text) for _, text in rows]
    counts = Counter(pair for f in found if f for pair in f[3])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for (doc_id, _), f in zip(rows, found):
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        out.append((doc_id, n_a, n_b, groups.count(";") + 1, len(links),
                    sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
                    sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (1, "Hello world, hello wörld!"), (2, None), (3, ""), (4, " "), (5, "  leading and  double  spaces "),
    (6, "日本語のテキスト and emoji 🙂🙃"), (7, "<|endoftext|> <s> </s> plain"), (8, "a▁b"), (9, "tab\tand\nnew line\r\n"),
    (10, "Ａ ﬁ é \xa0 zero\x00byte"), (1, "Hello world, hello wörld!"), (None, "no number at all"),
    (12, "x" * 3000), (13, "don't they'll we've 12345 6.5e-3 http://a.b/c?d=e"), (14, "the the the the"),
]


def _digest(spark, tmp_path, rows, monkeypatch=None, schema="doc_id bigint, text string"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in alignment.op11_token_alignment(spark, str(tmp_path)).collect()), key=str)


def test_equals_brute_force(spark, tmp_path, brute):
    rng = random.Random(3)
    words = ["the", "naïve", "Straße", "token", "ization", "of", "über", "12", "—", "x_y", "ation", "ing"]
    rows = ROWS + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)]
    assert _digest(spark, tmp_path, rows) == expected(brute, rows)


def test_small_chunks_and_segments_give_the_same(spark, tmp_path, brute, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["alpha", "beta-gamma", "Δ", "it's", "so", "a  b"], k=80))) for i in range(30)]
    whole = expected(brute, rows)
    monkeypatch.setattr(alignment, "REMEMBERED", 2000)
    monkeypatch.setattr(alignment, "SEGMENT", 20)
    monkeypatch.setattr(alignment, "TOGETHER", 100)
    for text in [t for _, t in rows[:5]]:
        found = alignment.Aligner(alignment.ByteLevelSide(A), alignment.PieceSide(B))
        monkeypatch.setattr(alignment.segments, "__defaults__", (20,))
        monkeypatch.setattr(alignment, "LINKS_HELD", 10)
        assert len(list(alignment.segments(text))) > 3
        cut = found.texts([text.encode()])[0]
        n_a, n_b, groups, links = brute(text)
        assert (cut.n_a, cut.n_b, cut.groups, cut.n_links) == (n_a, n_b, groups, len(links))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in alignment.op11_token_alignment(spark, str(tmp_path)).collect()), key=str)
    assert got == whole


def test_long_text_is_cut_and_complete(brute):
    found = alignment.Aligner(alignment.ByteLevelSide(A), alignment.PieceSide(B))
    text = "some words of a long text, and more. " * 20000
    parts = list(alignment.segments(text))
    assert len(parts) > 2 and " ".join(parts) == text
    cut = found.texts([text.encode()])[0]
    assert cut.n_a == len(Tokenizer.from_file(A).encode(" " + text, add_special_tokens=False).ids)
    assert cut.times.sum() == cut.n_links and len(cut.pairs) < 100
    unbroken = "語" * 100_000
    assert list(alignment.segments(unbroken)) == [unbroken]
    assert found.texts([unbroken.encode()])[0].n_groups > 0


def test_words_alone_give_what_the_whole_text_gives(brute):
    """Cuts at spaces beside marks, digits, white space of other kinds, joined signs."""
    found = alignment.Aligner(alignment.ByteLevelSide(A), alignment.PieceSide(B))
    rng = random.Random(6)
    signs = list("ab'9.,!-_ \n\t\r\x0b\x1c\x85\xa0\u2003\u3000é́ßŁ²½🙂\u200d語ا'") + [" "] * 30 + ["ll", "ing", "'s", " the"]
    for _ in range(1500):
        text = "".join(rng.choices(signs, k=rng.randint(1, 40)))
        cut, whole = found.texts([text.encode()])[0], brute(text)
        if whole is None:
            assert (cut.n_a, cut.groups) == (0, "")
        else:
            n_a, n_b, groups, links = whole
            assert (cut.n_a, cut.n_b, cut.groups, cut.n_links) == (n_a, n_b, groups, len(links)), repr(text)
            counts = Counter(j << 32 | i for i, j in links)
            assert dict(zip(cut.pairs.tolist(), cut.times.tolist())) == counts


def test_bytes_that_are_no_text_have_no_tokens():
    found = alignment.Aligner(alignment.ByteLevelSide(A), alignment.PieceSide(B))
    cut = found.texts([b"\xff\xfe", None, b"a"])
    assert [(t.n_a, t.groups != "") for t in cut] == [(0, False), (0, False), (1, True)]


def test_empty_table_and_clashing_columns(spark, tmp_path):
    schema = ("doc_id bigint, text string, chunk string, pairs int, places int, times int, n_best int, count_sum int, "
              "pair int, b int, groups int")
    assert _digest(spark, tmp_path, [], schema=schema) == []
    rows = [(1, "one two", "x", 1, 2, 3, 4, 5, 6, 7, 8), (2, None, None, None, None, None, None, None, None, None, None)]
    (tmp_path / "more").mkdir()
    got = _digest(spark, tmp_path / "more", rows, schema=schema)
    assert [r[0] for r in got] == [1, 2] and got[1][1:] == (0, 0, 0, 0, 0, 0, "")


def test_pair_counts_name_the_best(spark):
    df = spark.createDataFrame([(1, "abc abc abc"), (2, "abc")], "doc_id bigint, text string")
    aligned = pin(alignment.align(df, A, B), "test-aligned")
    rows = alignment.pair_counts(aligned).collect()
    assert sum(r["count"] for r in rows) == aligned.agg(F.sum("n_links")).first()[0]
    for b in {r.pair >> 32 for r in rows}:
        some = [r for r in rows if r.pair >> 32 == b]
        assert {r["count"] for r in some if r.best} == {max(r["count"] for r in some)}
