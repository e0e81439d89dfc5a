import html
import re
import zlib

import numpy as np
import pytest

from tenura.llm import language, quality
from tenura.llm.html_text import extract, main_text, op4_html_text

from ..conftest import DATA

LONG = "This is the story of a house and of the people that were in it, who had been there for as long as they could tell, and it is not at all what you would have thought of it. "


def article(page):
    """The article element of the given tables' pages, by plain patterns."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    inner = re.sub(r"<[^>]*$", "", inner)
    inner = re.sub(r"</?b>", "", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_pages_of_the_tables(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in op4_html_text(spark, folder).collect():
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a &lt; b &amp;amp; c&nbsp;d", "a < b &amp; c d"),
    ("<p>x<script>if (a<b) '</p>'</script>y</p>", "xy"), ("<p>a<b>b</b>c<br>d\n e</p><p>f", "abc d e f"),
    ("<p>before</p><!-- <p>hidden</p> --><p>after</p><!-- open <p>x", "before after"),
    ("<p>kept</p><foo", "kept"), ("<p>1 < 2 and 3 <4</p>", "1 < 2 and 3 <4"),
    ("<nav><p>menu</p></nav><p>body</p><footer>end</footer>", "body"),
    ("<div class='comments'><p>first!</p></div><p>body</p>", "body"),
    ("<div class=cookie-notice>we use them</div><p hidden>no</p><p role=alert>no</p><p>body</p>", "body"),
    ("<main><h1>T</h1><p>b</p></main><p>outside</p>", "T b"),
    ("<article><header><h1>Head</h1></header><p>b</p><form><p>f</p></form></article>", "Head b"),
    ("<title>t</title><textarea>x</textarea><p title=\"a > b\">y</p>", "y"),
    ("<p>" + LONG + "</p><p>short</p><ul><li><a href=1>one link</a></li><li><a href=2>two</a></li></ul><p>tail</p>", (LONG + "short").strip()),
])
def test_markup(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", [
    "<div class='content-sidebar-wrap'><p>{}</p></div>", "<div class='layout has-sidebar'><article><p>{}</p></article></div>",
    "<article class='post comments-open'><p>{}</p></article>", "<article class='post tag-social'><p>{}</p></article>",
    "<form action=x><div><p>{}</p></div></form>", "<div class=sidebar><main><p>{}</p></main></div>",
    "<div class=sidebar><p>{}</p></div>", "<div><p>{}</p></div><article><a href=1>More of this</a></article>",
    "<p>{}</p><div class='comments'><p>" + LONG + "</p></div>",
])
def test_wrappers_keep_their_text(page):
    assert main_text(page.format(LONG * 2)) == (LONG * 2).strip()


def test_two_passes_without_landmark():
    links = "<div><a href=1>" + "some linked words " * 5 + "</a></div>"
    page = f"{links}<p>near links</p>{links}<h2>Title</h2><p>{LONG * 2}</p><p>short</p><p>{LONG * 2}</p>{links}<p>end</p>{links}"
    assert main_text(page) == " ".join(["Title", (LONG * 2).strip(), "short", (LONG * 2).strip()])


def test_extract_edges(spark):
    rows = [(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (None, None, None, None), (2, "v", "<p>" + "many words " * 200_000, 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = extract(df, ["page_id", "url"]).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 2_199_999)]
    assert extract(df.limit(0), ["page_id"]).collect() == []


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = language.op5_language_id(spark, folder).collect()
    assert {r.doc_id for r in got} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert np.mean(held) >= 0.98


def test_language_model(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "nothing", None), (4, None, "en")]
    df = spark.createDataFrame(rows * 30, "doc_id bigint, text string, lang string")
    model = language.learn(df)
    assert model.languages == ["de", "en"]
    assert model.predict("und die") [0] == "de" and model.predict(None) == ("und", 0.0) == model.predict("12 +/ 3")
    both = model.shares(language.words_of("the cat and the dog " * 20 + "der hund und die katze " * 10))
    assert both[1] == pytest.approx(2 / 3, abs=0.1)
    texts = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "the dog " * 300_000, 3), (3, "und", 3)], "doc_id bigint, text string, score int")
    got = sorted((r.doc_id, r.lang_pred) for r in language.label(texts, model, ["doc_id"]).collect())
    assert got == [(1, "und"), (2, "und"), (3, "de"), (3, "en")]
    none = language.learn(df.limit(0))
    assert {r.lang_pred for r in language.label(texts, none, ["doc_id"]).collect()} == {"und"}
    assert language.label(texts.limit(0), model, ["doc_id"]).collect() == []


def test_counts_equal_plain_counting(spark):
    words = ["ab", "é"]
    hashed, starts = language.trigrams(words)
    assert len(hashed) == 4 and starts.tolist() == [0, 2]
    rows = [("ab é", "x"), ("ab", "x"), ("ab", "y")]
    df = spark.createDataFrame(rows, "text string, lang string")
    from pyspark.sql import functions as F
    got = {(r.lang, r.bucket): r.n for r in language.trigram_counts(df, F.col("text"), F.col("lang")).collect()}
    expected = {}
    for text, lang in rows:
        for h in language.trigrams(text.split())[0].tolist():
            expected[lang, h] = expected.get((lang, h), 0) + 1
    assert got == expected


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = quality.op6_quality(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and len(got) == 10_000
    held = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = (np.array([s for s, y, _ in held if y == k]) for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() >= 0.97
    assert np.mean([y == p for _, y, p in held]) >= 0.97


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    values = rng.random((4000, 3))
    labels = ((values[:, 0] > 0.5) ^ (values[:, 1] > 0.5)).astype(float)
    model = quality.fit(values, labels)
    assert (0, 1) in model.pairs
    assert ((model.score(values) > 0.5) == labels).mean() > 0.95
    assert quality.fit(values[:5], np.ones(5)).score(values[:2]).tolist() == pytest.approx([11 / 12] * 2)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "BAD!! ") * 9, 0) for i in range(200)]
                                 + [(None, None, 0), (500, "", 0), (501, "x " * 400_000, 0)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert len(got) == 203 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[i].predicted == i % 2 for i in range(200))
    empty = quality.learn(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, empty, ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs.limit(0), model, ["doc_id"]).collect() == []


def test_quality_with_clashing_names(spark):
    rows = [(i, "good words in a row, and more of them. " * 9 if i % 2 else "x 1 x 2 " * 20, 7, "a", 3, 4) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int, __id string, score int, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    model = quality.learn(df, labels)
    found = quality.score(df, model, df.columns)
    assert found.columns == ["doc_id", "text", "label", "__id", "score", "predicted"]
    assert all(r.predicted == r.doc_id % 2 and r.label == 7 and 0 <= r.score <= 1 for r in found.collect())


def test_pieces_hold_every_word_once(monkeypatch):
    text = "Alpha, beta-gamma δέλτα x1y " * 30 + "end"
    whole = language.words_of(text)
    for size in (1, 7, 50):
        monkeypatch.setattr(language, "PIECE", size)
        assert language.words_of(text) == whole
    assert whole["beta"] == 30 and language.words_of(None) == {} == language.words_of("1 2 _")


def test_language_of_a_very_long_text_in_little_memory():
    import tracemalloc
    docs = [("the cat and the dog sat on the mat", "en"), ("der hund und die katze auf der matte", "de")]
    counts = np.full((2, language.BUCKETS), language.SMOOTHING)
    for i, (text, _) in enumerate(docs):
        hashed, _ = language.trigrams(text.split())
        counts[i] += np.bincount(hashed, minlength=language.BUCKETS)
    model = language.Model(["en", "de"], np.log(counts / counts.sum(axis=1, keepdims=True)))
    text = (" ".join(f"word{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}" for i in range(5000)) + " ") * 1000
    assert len(text) > 30_000_000
    tracemalloc.start()
    name, share = model.predict(text)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert name in ("en", "de") and 0 < share <= 1


def pages_of(folder):
    import duckdb
    return [h for h, in duckdb.sql(f"SELECT html FROM '{folder}/pages.parquet' ORDER BY page_id").fetchall()]


def test_the_passes_alone_find_the_article():
    """Pages whose article and main elements are plain ones, and pages without any
    element, class, id or role that names its part."""
    import tenura.llm.html_text as module
    pages = pages_of("/root/testdata/sf0.01")
    same, lost, more, size = 0, 0, 0, 0
    for page in pages:
        plain = re.sub(r"<(/?)(article|main)\b", r"<\1div", page)
        whole = module.main_blocks(page)
        same += module.main_blocks(plain) == whole
        bare = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", page)
        bare = re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", bare)
        found = module.main_blocks(bare)
        lost += sum(len(b) for b in whole if b not in found)
        more += sum(len(b) for b in found if b not in whole)
        size += sum(map(len, whole))
    assert same >= 0.95 * len(pages)
    assert lost < 0.01 * size and more < 0.02 * size


def test_both_passes_equal_a_plain_version(monkeypatch):
    import random

    import tenura.llm.html_text as module
    rng = random.Random(12)

    def first(b):
        n = len(b.joined)
        if b.links > (0.67 if b.landmark else 0.33):
            return -1
        if not b.landmark and not b.paragraph and n < 200 and re.match(r"©|\(c\)|copyright\b", b.joined, re.I):
            return -1
        if (n >= 200 and b.stops >= 0.30) or (n >= 70 and b.stops >= 0.32):
            return 1
        if b.landmark:
            return 1 if n >= 70 else 0
        return -1 if n >= 70 and b.stops < 0.15 and not b.paragraph else 0

    def plain(blocks):
        labels = [first(b) for b in blocks]
        if 1 not in labels:
            labels = [-1 if b.links > 0.67 or (not b.landmark and not b.paragraph and len(b.joined) < 200 and b.joined.startswith("©"))
                      else 1 if len(b.joined) >= 70 else 0 for b in blocks]
        out = []
        for i, b in enumerate(blocks):
            if labels[i]:
                out.append(labels[i])
                continue
            decided = [j for j in range(len(blocks)) if labels[j]]
            if b.heading and any(j > i for j in decided):
                out.append(labels[min(j for j in decided if j > i)])
                continue
            pool = [j for j in decided if all(c.paragraph for c in blocks[min(i, j):max(i, j) + 1])]
            pool = pool or decided
            sides = [max((j for j in pool if j < i), default=None), min((j for j in pool if j > i), default=None)]
            sides = [j for j in sides if j is not None]
            near = [j for j in sides if abs(j - i) == min(abs(k - i) for k in sides)]
            out.append(max((labels[j] for j in near), default=1))
        return [b.joined for b, label in zip(blocks, out) if label == 1]

    words = ["the", "of", "and", "blorp", "zint", "quax", "grendel", "is"]
    for _ in range(400):
        blocks = []
        for _ in range(rng.randrange(12)):
            text = " ".join(rng.choices(words, k=rng.choice([2, 5, 12, 20, 45])))
            block = module.Block([rng.choice(["", "", "", "© "]) + text], paragraph=rng.random() < 0.5, heading=rng.random() < 0.1)
            block.linked = rng.choice([0, 0, 0, len(text) // 2, len(text)])
            blocks.append(block.close())
        monkeypatch.setattr(module, "blocks_of", lambda html: (blocks, set()))
        assert module.main_blocks("x") == plain(blocks)


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + "</p>" * 20_000 + "text", "<div class=sidebar>" * 20_000 + "text", "<form>" * 20_000 + "some text" + "</form>" * 20_000,
    "<b>" * 20_000 + "<hr>" * 20_000 + "text", "<a>" * 20_000 + "x" + "</a>" * 20_000, "<p><b>" * 20_000 + "text",
])
def test_depth_costs_linear_time(page):
    import time
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 3
