"""Main text of web pages by two passes of block rules.

A page is read into blocks: stretches of text between block-level tags. First pass, each block alone: link density,
length and the share of stop words make it good, bad, or undecided when it is short. Second pass: undecided blocks
inherit the label of the nearest decided neighbours (both alike, or the one in the same section, or the nearer).

Structure enters as evidence: what lies in menus, page headers, footers, asides, forms, notices, adverts and reader
comments (by tag, role, class or id) is bad, and a page that marks its article is read there, where a block is only
bad by its links or its place. Scripts, styles, comments and markup are no text.

Defined results: null, empty and text-free pages give ""; broken, unclosed or truncated markup is read as far as it
goes; a very long page is read whole; ids and urls may be null or repeat, each row is judged alone.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers_ready

#: Fixed: frequent function words of the languages read
STOP_WORDS = frozenset("""
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one
you were all her she there would their we him been has when who will no more if out so up said what its about than
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou aux son mais
nous elle leur cette comme sans ses ont deux meme
der die und das den von zu mit sich des auf fur ist im dem nicht ein eine als auch es an werden aus er hat dass sie
nach wird bei einer um am sind noch wie einem uber einen so zum war haben nur oder aber vor zur bis mehr durch
el los y que en un por con no una su para al lo como mas o pero sus le ha me si sin sobre este ya entre cuando todo
esta ser son dos tambien fue habia era muy anos hasta desde
""".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
pre search section select summary table tbody td tfoot th thead title tr ul""".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SKIPPED = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "object", "head", "canvas", "math", "audio", "video"))
BAD_TAGS = frozenset(("nav", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog", "fieldset", "search", "label", "input"))
ARTICLE = frozenset(("article", "main"))
BAD_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu"))
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|disqus|footer|foot|gdpr|"
    r"header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|outbrain|pagination|pager|popup|promo\w*|related|"
    r"replies|responses|share|sharing|sidebar|side|social|sponsor\w*|subscribe|subscription|taboola|toolbar|topbar|widgets?|"
    r"login|signup|skip|recommend\w*)(?:$|[\s_-])", re.I)
LISTS = frozenset(("li", "dt", "dd", "option"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))

MAX_LINKS = 0.2  # share of characters in links beyond which a block is bad
SHORT = 70  # characters; shorter blocks are left to the second pass
LONG = 200
STOP_LOW, STOP_HIGH = 0.15, 0.25
LIST_LIKE = 0.5  # a list of the marked article, or a block with no text but links, may have this share of links
_SPACE = re.compile(r"\s+")


class _Block:
    __slots__ = ("parts", "linked", "bad", "article", "heading", "listed", "plain", "label")

    def __init__(self, bad, article, heading, listed):
        self.parts, self.linked, self.bad, self.article, self.heading, self.listed = [], 0, bad, article, heading, listed
        self.plain, self.label = False, 0  # plain: some words are outside links

    @property
    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()


class _Reader(HTMLParser):
    """Cuts a page into blocks. Open elements are a stack; an end tag closes back to its start tag, if there is one.

    Where each tag is open is kept beside the stack, so that no step looks through it, however deep it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[_Block] = []
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, bad, article, skipped
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.block_tags: list[int] = []  # places of block-level elements
        self.links = self.lists = 0
        self.block = None

    def parse_marked_section(self, i, report=1):
        """``<![`` is a comment up to the next ``>`` (``]]>`` for character data), whatever its keyword."""
        end = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        j = self.rawdata.find(end, i + 3)
        return j + len(end) if j >= 0 else -1

    def _close(self):
        if self.block is not None and self.block.parts:
            self.blocks.append(self.block)
        self.block = None

    def _push(self, tag, bad, article, skipped):
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.block_tags.append(len(self.stack))
        self.lists += tag in LISTS
        self.links += tag == "a"
        self.stack.append((tag, bad, article, skipped))

    def _pop(self, i):
        while len(self.stack) > i:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if tag in BLOCKS:
                self.block_tags.pop()
            self.lists -= tag in LISTS
            self.links -= tag == "a"

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close()
            if tag not in ("head", "title") and self.open.get("head"):  # a head that was left open ends at the first block
                self._pop(self.open["head"][0])
        if tag in ("br", "hr") and self.block is not None:
            self.block.parts.append(" ")
        if tag in VOID:
            return
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option", *HEADINGS):
            self._implied_end(tag)
        _, bad, article, skipped = self.stack[-1] if self.stack else ("", False, False, False)
        if not skipped:
            a = {k: v or "" for k, v in attrs}
            names = f"{a.get('class', '')} {a.get('id', '')}"
            bad = bad or tag in BAD_TAGS or a.get("role", "").lower() in BAD_ROLES or "hidden" in a or a.get("aria-hidden") == "true" \
                or (tag not in ("html", "body", *ARTICLE) and bool(_BAD_NAME.search(names))) or (tag == "header" and not article)
            skipped = tag in SKIPPED
            if tag in ARTICLE and not bad:
                article = True
            if tag == "article" and self._in_comments(names):
                bad = True
        self._push(tag, bad, article, skipped)

    @staticmethod
    def _in_comments(names: str) -> bool:
        return bool(re.search(r"comment|reply|response", names, re.I))

    def _implied_end(self, tag):
        """A paragraph ends where the next begins, even if an inline element in it was left open."""
        if self.block_tags and self.stack[self.block_tags[-1]][0] == tag:
            self._pop(self.block_tags[-1])

    def handle_startendtag(self, tag, attrs):
        """A slash makes no element empty in HTML, so <p/> opens a paragraph."""
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._close()
        if self.open.get(tag):
            self._pop(self.open[tag][-1])

    def handle_data(self, data):
        _, bad, article, skipped = self.stack[-1] if self.stack else ("", False, False, False)
        if skipped or not data:
            return
        if self.block is None and not data.strip():
            return
        # A block that began with an inline advert or button begins anew at its first good text.
        if self.block is None or self.block.bad and not bad and data.strip():
            self.block = _Block(bad, article, any(x[0] in HEADINGS for x in self.stack[-3:]), self.lists > 0)
        if bad and not self.block.bad:  # an inline advert or button in a good block
            return
        self.block.parts.append(data)
        if self.links:
            self.block.linked += len(data.strip())
        elif any(map(str.isalnum, data)):
            self.block.plain = True


def blocks_of(html: str) -> list[_Block]:
    reader = _Reader()
    whole = html.rfind(">") + 1  # no tag ends behind it, so what is there is text, read at once
    reader.feed(html[:whole])
    reader.close()
    if whole < len(html) and not reader.cdata_elem:
        reader.handle_data(unescape(html[whole:]))
    reader._close()
    return [b for b in reader.blocks if b.text]


def _first_pass(b: _Block, marked: bool) -> int:
    """1 good, -1 bad, 0 undecided."""
    text = b.text
    if b.bad:
        return -1
    if b.article:
        if b.linked > LIST_LIKE * len(text) and (b.listed or not b.plain):
            return -1
    elif b.linked > (LIST_LIKE if b.plain and not b.listed and len(text) >= SHORT else MAX_LINKS) * len(text):
        return -1  # a paragraph may have more of its words in links than a list or a short line
    if marked and not b.article:
        return -1
    if b.heading or len(text) < SHORT:
        return 0
    words = text.lower().split()
    density = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(len(words), 1)
    if density >= STOP_HIGH:
        return 1
    if density >= STOP_LOW:
        return 1 if len(text) > LONG else 0
    return 0 if b.article else -1


def _second_pass(blocks: list[_Block], labels: list[int], marked: bool) -> list[int]:
    n = len(blocks)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        before[i] = last
        if labels[i]:
            last = i
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        if labels[i]:
            last = i
    out = list(labels)
    for i in range(n):
        if labels[i]:
            continue
        near = [j for j in (before[i], after[i]) if j is not None]
        if marked and blocks[i].article:  # only neighbours in the article count; alone there, a block is its text
            near = [j for j in near if blocks[j].article and not blocks[j].bad and labels[j] > 0]
            out[i] = 1
        elif not near:
            out[i] = -1 if not marked and blocks[i].linked else 1
        elif blocks[i].heading:  # a heading belongs to what follows it
            out[i] = labels[after[i]] if after[i] is not None else labels[near[0]]
        elif len({labels[j] for j in near}) == 1:
            out[i] = labels[near[0]]
        else:
            out[i] = labels[min(near, key=lambda j: abs(j - i))]
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks = blocks_of(html)
    marked = any(b.article and not b.bad for b in blocks)
    labels = _second_pass(blocks, [_first_pass(b, marked) for b in blocks], marked)
    return "\n\n".join(b.text for b, k in zip(blocks, labels) if k > 0)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    workers_ready(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
