import random
import re

import pytest

from tenura.llm import licences
from tenura.llm.licence_texts import PHRASES, TEMPLATES

SEPARATORS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return SEPARATORS.findall(lowered)


def passages_of(sequences):
    """Every passage with the places where it ends."""
    out = {}
    for number, s in enumerate(sequences):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                out.setdefault(tuple(s[i:j]), []).append((number, j - 1))
    return out


def brute_statistics(words, passages, longest):
    out = []
    for end in range(len(words)):
        n = 0
        for size in range(1, min(longest, end + 1) + 1):
            if tuple(words[end - size + 1:end + 1]) in passages:
                n = size
        out.append(n)
    return out


def brute_shares(words, phrases, templates):
    """Best share of each template over all chains, by the full quadratic program."""
    sequences = [plain_words(t) for _, t in [*phrases, *templates]]
    passages = passages_of(sequences)
    stats = brute_statistics(words, passages, max(map(len, sequences)))
    seeds = [(i, n) for i, n in enumerate(stats)
             if n >= licences.LONG and not (i + 1 < len(stats) and stats[i + 1] == n + 1)]
    best, chains = {}, []
    for place, n in seeds:
        for number, at in passages[tuple(words[place - n + 1:place + 1])]:
            if number < len(phrases):
                continue
            covered = n
            for other, last, other_at, c in chains:
                again = max(0, last - (place - n), other_at - (at - n))
                if other == number and last < place and last >= place - n - licences.GAP and \
                        0 < at - other_at <= n + licences.GAP and again < n:
                    covered = max(covered, c + n - again)
            chains.append((number, place, at, covered))
            best[number] = max(best.get(number, 0), covered / len(sequences[number]))
    return {k: v for k, v in best.items() if v >= licences.COVERED}


def noisy(rng, text):
    words = text.split()
    for _ in range(rng.randint(0, 4)):
        kind, at = rng.random(), rng.randrange(len(words))
        if kind < 0.4:
            words[at] = "odd"
        elif kind < 0.7:
            words.insert(at, "odd extra")
        else:
            del words[at]
    return " ".join(words)


TEXTS = [
    None, "", " \n\t", "plain words without any", "MIT License", "the mit license, mit-license; MIT LICENSE",
    "CC BY", "cc  by cc by", "ccby", "CC BY-NC 4.0", "gnu general public license", "GNU General Public", "É mit license é",
    "apache license apache license", "x" * 100_000, "cc by " * 3000,
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    filler = "the of and software license is in to any you may odd".split()
    out = list(TEXTS)
    for _, text in [*PHRASES, *TEMPLATES]:
        for _ in range(4):
            out.append(" ".join([*rng.choices(filler, k=rng.randint(0, 30)), noisy(rng, text),
                                 *rng.choices(filler, k=rng.randint(0, 30))]))
    for _ in range(20):
        out.append(" ".join(noisy(rng, rng.choice(TEMPLATES)[1]) for _ in range(3)))
    return out


def test_statistics_equal_brute_force(texts):
    found = licences.Scanner(PHRASES, TEMPLATES)
    found.shortest = 1
    sequences = [plain_words(t) for _, t in [*PHRASES, *TEMPLATES]]
    passages, longest = passages_of(sequences), max(map(len, sequences))
    for text in texts[4:60]:
        words = plain_words(text)[:400]
        got = dict.fromkeys(range(len(words)), 0)
        for place, state, length in found.statistics([w.encode() for w in words]):
            got[place] = length
            ends = found.automaton.ends[state]
            assert sorted(ends) == sorted(passages[tuple(words[place - length + 1:place + 1])])
        assert list(got.values()) == brute_statistics(words, passages, longest)


def test_spans_equal_brute_force(texts):
    found = licences.Scanner(PHRASES, TEMPLATES)
    for text in texts:
        words = plain_words(text)
        n, spans = found.scan((text or "").encode())
        assert n == len(words)
        base = sorted((s["template"], s["first_word"]) for s in spans if s["template"] < len(PHRASES))
        assert base == sorted((p, i) for p, (_, phrase) in enumerate(PHRASES) for i in range(len(words))
                              if words[i:i + len(phrase.split())] == phrase.split())
        if len(words) < 2000:
            best = {}
            for s in spans:
                if s["template"] >= len(PHRASES):
                    best[s["template"]] = max(best.get(s["template"], 0), s["share"])
            assert best == pytest.approx(brute_shares(words, PHRASES, TEMPLATES))
        for number in {s["template"] for s in spans if s["template"] >= len(PHRASES)}:
            some = sorted((s["first_word"], s["last_word"]) for s in spans if s["template"] == number)
            assert all(a[1] < b[0] for a, b in zip(some, some[1:]))


def test_every_template_is_found_and_clean_text_is_not():
    found = licences.Scanner(PHRASES, TEMPLATES)
    for number, (label, text) in enumerate(TEMPLATES, len(PHRASES)):
        _, spans = found.scan(f"Some words before. {text} And after.".encode())
        assert (label, 1.0) in {(s["label"], s["share"]) for s in spans if s["template"] == number}
    clean = "The work is in the public library and you may use it for any purpose you like. " * 50
    assert found.scan(clean.encode())[1] == []


def test_two_copies_give_two_spans():
    found = licences.Scanner(PHRASES, TEMPLATES)
    text = next(t for label, t in TEMPLATES if label == "isc")
    _, spans = found.scan(f"{text} {'unrelated ' * 40} {text}".encode())
    assert [s["label"] for s in spans] == ["isc", "isc"] and spans[0]["last_word"] < spans[1]["first_word"]


def test_long_text_is_linear():
    import time
    found = licences.Scanner(PHRASES, TEMPLATES)
    took = []
    for times in (300, 1200):
        data = " ".join(t for _, t in TEMPLATES).encode() * times
        start = time.process_time()
        found.scan(data)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0]


def test_query(spark, tmp_path, texts):
    schema = "doc_id bigint, text string, spans int, base int, label string, n_words string"
    rows = [(i, t, 1, 2, "x", "y") for i, t in enumerate(texts)] + [(None, "mit license", 1, 2, "x", "y")] + [(4, TEXTS[4], 1, 2, "x", "y")]
    (tmp_path / "a").mkdir()
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "a/documents.parquet"))
    got = licences.op12_licence_scan(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0][1:] == (0, 0, None, None, "", "", 0.0)
    assert by_id[5][1:] == (6 + 1, 3, 1, 5, "mit", "mit", 1.0)
    assert by_id[None].base_labels == "mit" and sum(r.doc_id == 4 for r in got) == 2
    assert "cc-by-nc-4.0" not in by_id[9].labels.split(",") or by_id[9].base_labels == "cc-by"
    (tmp_path / "b").mkdir()
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert licences.op12_licence_scan(spark, str(tmp_path / "b")).count() == 0
