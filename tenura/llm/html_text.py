"""Main text of HTML pages by two-pass block rules.

A page is read once into blocks: text between block-level tags, with its words,
stop words, link characters and place. Parts that their element, role or class
names as page furniture (menus, footers, adverts, comments, ...) give no block;
forms and class names only where the main text is not within them.
Pass one judges each block by itself: link density, length and stop-word
density make it text, furniture or undecided. In pass two an undecided block
takes the label of its nearest decided neighbours. If the page has one article
or a main element that holds most of its text, only blocks within it are judged; length and stop words
can only speak for a block there, not against it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import map_batches, table, with_text

SHORT, LONG = 70, 200  # characters
FEW_STOP, MANY_STOP = 0.30, 0.32  # share of words
MANY_LINKS, ONLY_LINKS = 0.33, 0.67  # share of characters
UNKNOWN, TEXT, FURNITURE = 0, 1, -1

# Frequent function words of the languages of the pages.
STOP_WORDS = frozenset("""
a an and are as at be been but by for from had has have he her his i if in into is it its no not of on or our
she so than that the their there they this to was we were what which who will with would you your
als am auch auf aus bei bin bis da das dem den der des die doch du durch ein eine einem einen einer es für hat
ich ihr im ist ja kann man mit nach nicht noch nur oder sich sie sind und von vor war was wie wir zu zum zur über
au aux avec ce ces cette dans de du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas
plus pour qu que qui sa se ses son sur un une vous
al como con del el ella ellos era es esta este ha hay lo los las más me mi muy no para pero por porque se si sin
sobre su sus también todo una uno y ya
""".split())

# Element names of HTML by their part in a page.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q
ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr""".split())
LANDMARKS = frozenset(["article", "main"])
FURNITURE_TAGS = frozenset("""nav footer aside button select option fieldset menu dialog object audio video
canvas head""".split())
FURNITURE_ROLES = frozenset("""navigation banner contentinfo complementary search dialog alertdialog alert menu
menubar toolbar""".split())
FURNITURE_NAMES = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs footer foot sidebar aside notice
notices notification cookie cookies consent gdpr alert ad ads adv advert adverts advertisement advertising adsense
sponsor sponsored promo promotion comment comments disqus respond reply replies share sharing social related
recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager copyright
disclaimer skip tags toc outbrain taboola""".split())
WEAK_NAMES = frozenset("header head masthead banner topbar toolbar search".split())
CONTENT_NAMES = frozenset("article post entry content main story body text title headline".split())
NEUTRAL_NAMES = frozenset("site page list area box wrap wrapper container inner outer block bar section links primary secondary top bottom left right".split())
ENDED_BY_BLOCK = frozenset(["p"])
PARAGRAPHS = frozenset("p blockquote pre dd td".split())
# A line of rights outside paragraphs is no text.
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)

COMMENT = re.compile(r"--!?>")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=|["'])*+)>""")
ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
NAMES = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: list[str] = field(default_factory=list)
    linked: int = 0
    landmark: int = 0  # number of the outermost article or main
    doubtful: int = -1  # number of the innermost form or named element around it
    heading: bool = False
    paragraph: bool = False
    label: int = UNKNOWN

    def close(self) -> "Block":
        self.joined = " ".join("".join(self.text).split())
        words = [w.strip(".,;:!?\"'()[]*#$%&|").lower() for w in self.joined.split(" ")]
        self.stops = sum(w in STOP_WORDS for w in words) / len(words)
        self.links = min(1.0, self.linked / len(self.joined)) if self.joined else 0.0
        return self


def is_furniture(tag: str, attributes: str, in_landmark: bool) -> bool:
    """Does the element say of itself that it isn't part of the main text?"""
    if tag in FURNITURE_TAGS or tag == "header" and not in_landmark:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            continue
        elif name == "role":
            if value.lower() in FURNITURE_ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def is_doubtful(tag: str, attributes: str) -> bool:
    """Is it a form, or is a whole class or id word a name of furniture?"""
    if tag == "form":
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        if name.lower() == "role" and value.lower() == "form":
            return True
        if name.lower() in ("class", "id"):
            tokens = [set(NAMES.findall(CAMEL.sub(" ", t).lower())) for t in value.split()]
            weak = frozenset() if any(t & CONTENT_NAMES for t in tokens) else WEAK_NAMES
            if any(t & (FURNITURE_NAMES | weak) and t <= FURNITURE_NAMES | weak | NEUTRAL_NAMES for t in tokens):
                return True
    return False


class Reader:
    """Blocks of one page. ``open`` holds (tag, furniture, landmark, heading, doubtful,
    place of the innermost open element that is no inline one)."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.block = Block()
        self.open: list[tuple[str, bool, int, bool, int, int]] = [("", False, 0, False, -1, 0)]
        self.tags: Counter[str] = Counter()  # open elements
        self.forms: list[bool] = []  # of the doubtful elements, by number
        self.around: list[int] = []  # the doubtful element around each, or -1
        self.regions, self.mains = 0, set()
        self.holds_main, self.holds_article = set(), set()
        self.anchors = 0

    def end_block(self) -> None:
        if any(not t.isspace() for t in self.block.text):
            self.blocks.append(self.block.close())
        tag, _, landmark, heading, doubtful, _ = self.open[-1]
        self.block = Block(landmark=landmark, heading=heading, doubtful=doubtful, paragraph=tag in PARAGRAPHS)

    def text(self, raw: str) -> None:
        if raw and not self.open[-1][1]:
            value = unescape(raw) if "&" in raw else raw
            self.block.text.append(value)
            if self.anchors:
                self.block.linked += len("".join(value.split()))

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag == "img":
            self.text(" ") if tag == "br" else None
            return
        inline = tag in INLINE
        if not inline:
            # A block ends an open paragraph, with what is left open in it.
            at = self.open[-1][5]
            if self.open[at][0] in ENDED_BY_BLOCK or tag in ("li", "option", "dt", "dd") and self.open[at][0] == tag:
                self.pop_to(at)
        if tag in EMPTY:
            self.end_block() if tag == "hr" else None
            return
        _, furniture, landmark, heading, doubtful, last = self.open[-1]
        furniture = furniture or is_furniture(tag, attributes, bool(landmark))
        if not furniture and is_doubtful(tag, attributes):
            self.around.append(doubtful)
            doubtful = len(self.forms)
            self.forms.append(tag == "form")
        main = tag == "main" or tag == "div" and 'role="main"' in attributes
        if not furniture and (main or tag in LANDMARKS) and not landmark:
            self.regions += 1
            landmark = self.regions
            self.holds_article.add(doubtful)
        if main and not furniture:
            self.mains.add(landmark)
            self.holds_main.add(doubtful)
        heading = heading or len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        self.open.append((tag, furniture, landmark, heading, doubtful, last if inline else len(self.open)))
        self.tags[tag] += 1
        self.anchors = self.tags["a"]
        if not inline:
            self.end_block()

    def end(self, tag: str) -> None:
        if not self.tags[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self.pop_to(at)
                if tag not in INLINE:
                    self.end_block()
                return
            # An inline end tag doesn't reach beyond its block.
            if tag in INLINE and self.open[at][0] not in INLINE:
                return

    def pop_to(self, at: int) -> None:
        for x in self.open[at:]:
            self.tags[x[0]] -= 1
        self.anchors = self.tags["a"]
        del self.open[at:]

    def with_around(self, numbers: Iterable[int]) -> set[int]:
        """These doubtful elements and all around them."""
        found: set[int] = set()
        for n in numbers:
            while n >= 0 and n not in found:
                found.add(n)
                n = self.around[n]
        return found

    def within(self, kept: set[int]) -> list[Block]:
        """The blocks all of whose doubtful elements are kept."""
        whole: list[bool] = []
        for n, outer in enumerate(self.around):  # an outer one has the smaller number
            whole.append(n in kept and (outer < 0 or whole[outer]))
        return [b for b in self.blocks if b.doubtful < 0 or whole[b.doubtful]]


def spared(reader: Reader) -> list[Block]:
    """The blocks without those in doubtful elements. A doubtful element stays if it
    holds main; a form also if it holds an article or text; and any that holds an
    article or text if there is neither outside."""
    def forms(numbers: Iterable[int]) -> set[int]:
        return {n for n in reader.with_around(numbers) if reader.forms[n]}

    kept = reader.with_around(reader.holds_main) | forms(reader.holds_article)
    kept |= forms(b.doubtful for b in reader.blocks if judge(b, False) == TEXT)
    outside = reader.within(kept)
    if not any(b.landmark or judge(b, False) == TEXT for b in outside):
        kept |= reader.with_around(reader.holds_article)
        kept |= reader.with_around(b.doubtful for b in reader.blocks if judge(b, not outside) == TEXT)
    return reader.within(kept)


def blocks_of(html: str) -> tuple[list[Block], set[int]]:
    """The blocks of a page that aren't furniture by their elements, in order, and
    the numbers of its main regions."""
    reader, at, size = Reader(), 0, len(html)
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            reader.text(html[at:])
            break
        reader.text(html[at:mark])
        if html.startswith("<!--", mark):
            closed = COMMENT.search(html, mark + 2)
            at = closed.end() if closed else size
            continue
        found = TAG.match(html, mark)
        if found:
            at = found.end()
            tag = found[2].lower()
            if found[1]:
                reader.end(tag)
            elif tag in RAW and not found[3].endswith("/"):
                closed = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                at = closed.start() if closed else size
            else:
                reader.start(tag, found[3])
            continue
        following = html[mark + 1:mark + 2]
        if following in "!?/" and following or following.isalpha() and following.isascii():
            closed = html.find(">", mark)  # a declaration, or a tag that the page's end cuts off
            at = closed + 1 if closed >= 0 else size
        else:
            reader.text("<")
            at = mark + 1
    reader.end_block()
    return spared(reader), reader.mains


def judge(block: Block, in_landmark: bool) -> int:
    """Pass one. A paragraph in few stop words is left undecided, as its language may
    have no list; other blocks of that kind are furniture."""
    size = len(block.joined)
    if block.links > (ONLY_LINKS if in_landmark else MANY_LINKS):
        return FURNITURE
    if not (block.landmark or block.paragraph) and size < LONG and RIGHTS.match(block.joined):
        return FURNITURE
    if size >= LONG and block.stops >= FEW_STOP or size >= SHORT and block.stops >= MANY_STOP:
        return TEXT
    if in_landmark:
        return TEXT if size >= SHORT else UNKNOWN
    if size < SHORT:
        return UNKNOWN
    return FURNITURE if block.stops < FEW_STOP / 2 and not block.paragraph else UNKNOWN


def main_blocks(html: str) -> list[str]:
    """Both passes; the texts of the blocks that are main text, in page order.

    An undecided block between a text and a furniture block takes the label of
    the nearer one, text on a tie; a paragraph first asks the paragraphs that it
    stands among, a heading looks only forward, if anything follows. If no block is text by its stop words, they are left out; a page
    on which nothing is decided is text throughout."""
    blocks, mains = blocks_of(html)
    inside = [b for b in blocks if b.landmark]
    beside = sum(len(b.joined) for b in blocks if not b.landmark and judge(b, False) == TEXT)
    regions = {b.landmark for b in inside}
    if (len(regions) == 1 or regions & mains) and beside <= sum(len(b.joined) for b in inside):
        blocks = inside
    for block in blocks:
        block.label = judge(block, bool(block.landmark))
    if all(b.label != TEXT for b in blocks):
        for block in blocks:  # a language without a list: only links speak against a block
            block.label = judge(block, True)
    every, own = _neighbours(blocks), _neighbours(blocks, lambda b: not b.paragraph)
    labels = [b.label for b in blocks]
    for i, block in enumerate(blocks):
        if block.label:
            continue
        near = [x for x in own[i] if x is not None] if block.paragraph else []
        near = near or [x for x in every[i] if x is not None]
        if block.heading and every[i][1] is not None:
            near = [every[i][1]]
        if not near:
            labels[i] = TEXT
        elif len(near) == 2 and blocks[near[0]].label != blocks[near[1]].label:
            back, forth = i - near[0], near[1] - i
            labels[i] = TEXT if back == forth else blocks[near[0] if back < forth else near[1]].label
        else:
            labels[i] = blocks[near[-1]].label
    return [b.joined for b, label in zip(blocks, labels) if label == TEXT]


def _neighbours(blocks: list[Block], ends: Callable[[Block], bool] = lambda b: False
                ) -> list[tuple[int | None, int | None]]:
    """Of each block the nearest decided one before and after it, as far as no block
    in between or there ``ends`` the search."""
    before, last = [], None
    for i, block in enumerate(blocks):
        before.append(last)
        last = None if ends(block) else i if block.label else last
    after, following = [], None
    for i in range(len(blocks) - 1, -1, -1):
        after.append(following)
        following = None if ends(blocks[i]) else i if blocks[i].label else following
    return list(zip(before, reversed(after)))


def main_text(html: str | None) -> str:
    return " ".join(main_blocks(html)) if html else ""


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The ``keep`` columns of every row with ``text`` and ``n_chars`` (code points).

    Null, empty and textless pages give an empty text. Character references are
    decoded, white space within a block becomes one space, blocks are joined
    by one space. An unclosed tag at the end of a page is dropped, an unclosed
    comment hides what follows, like in a browser. Rows are mapped one by one."""

    rows, at, kept = with_text(pages, keep, html_col)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"])

    return map_batches(rows, task, f"{kept}, text string, n_chars bigint")


def op4_html_text(spark, data_dir: str) -> DataFrame:
    """Main text and its length of every page."""
    return extract(table(spark, data_dir, "pages"), ["page_id", "url"])
