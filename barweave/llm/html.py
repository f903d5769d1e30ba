"""Main text of web pages by rules on blocks, in two passes.

A page is cut into blocks at block-level tags. The first pass looks at each block alone: its length, its
share of stop words, and its share of link text make it good, bad, or (headings and shorter ones only)
undecided. The second pass gives undecided blocks the label of their nearest decided neighbours. Before
both, blocks in places that never hold the article (menus, footers, sidebars, notices, adverts, forms,
comments) are out, and where a page marks its article, only that is looked at.

Some of those places have elements or roles of their own; others only names in a class or id. A name counts
by the whole token it stands in ("has-sidebar" is a state, no sidebar), and an element that it would put
out stays if it holds more than half of the page's good text, and a title or an article. Forms, and names that are only part of a token, need
no title where the page marks no article elsewhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, whole_text

# HTML's element names by what they do to a block.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never markup: without an end tag they last to the end of the page.
RAW_TAGS = frozenset("script style title textarea noframes xmp".split())
#: Shown otherwise than as text, or not at all: left out as far as their end tag, if they have one.
SKIPPED_TAGS = frozenset("noscript template select button svg iframe object audio video canvas datalist annotation annotation-xml".split())
OUT_TAGS = frozenset("nav footer aside dialog menu search".split())
OUT_ROLES = frozenset("navigation complementary contentinfo search dialog alertdialog alert menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names in class or id of what is not the article; those of readers' comments.
OUT_NAMES = frozenset(
    "nav navbar navigation menu menubar footer sidebar aside complementary contentinfo breadcrumb breadcrumbs ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations teaser widget widgets pagination pager toolbar login search searchbox form skip copyright legal disclaimer outbrain taboola tags".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus discussion respond replies reply".split())
#: An article or main element is put out only by one of these as a whole token.
ARTICLE_OUT = frozenset("ad ads advert advertisement comment reply teaser related widget".split())
#: Names of what may well be the article, beside which a name of the above is a detail ("post tags").
ARTICLE_NAMES = frozenset("article post entry story content main page body".split())
#: A token says something about a state, a topic or a layout, not what it stands on, if one of these comes first, or last, or anywhere.
STATE_FIRST = frozenset("has with without no not is show hide js tag category cat type format status topic".split())
STATE_LAST = frozenset("open closed enabled disabled active inactive allowed on off visible".split())
STATE_ANY = frozenset("layout template".split())
#: Frequent function words, which running text of a language has many of.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be been but by can could for from had has have he her his how i if in into is it its more no not of on one or other our out she so some that the their them then there these they this to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist kann mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wie wird wir zu zum zur",
    "fr": "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur tout un une vous y été être",
    "es": "a al como con de del el ella en entre era es esta este ha hay la las lo los más me mi muy no nos o para pero por que se si sin sobre son su sus también un una uno y ya",
}
_STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())

#: Characters of a short and of a long block; shares of stop words and of link text, and what is as good as all link.
SHORT, LONG, STOPS_LOW, STOPS_HIGH, LINKS, LINKED = 60, 180, 0.12, 0.25, 0.4, 0.9

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_SENTENCE = re.compile(r"[.!?…。！？।](?:\s|$|[\"'»”’)])|[。！？]")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


@dataclass
class Block:
    text: str
    links: int
    main: bool
    heading: bool
    named: tuple[int, ...] = ()  # the elements around it that a name puts out
    lead: bool = False  # in the article's own header, and no heading
    label: int = 0  # 1 good, -1 bad, 0 undecided


@dataclass
class _Open:
    tag: str
    out: bool
    main: bool
    heads_only: bool
    named: tuple[int, ...]


class _Stack:
    """The open elements; where the last one of a name is, is known at once."""

    def __init__(self) -> None:
        self.open = [_Open("", False, False, False, ())]
        self.at: dict[str, list[int]] = {}
        self.blocks = [0]

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def push(self, element: _Open) -> None:
        self.at.setdefault(element.tag, []).append(len(self.open))
        if _is_block(element.tag):
            self.blocks.append(len(self.open))
        self.open.append(element)

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            tag = self.open.pop().tag
            self.at[tag].pop()
            if _is_block(tag):
                self.blocks.pop()


def _is_block(tag: str) -> bool:
    return tag in BLOCK_TAGS or "-" in tag


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _words(token: str) -> list[str]:
    """The words of a class or id, without those of tokens that only say in which state something is."""
    words = [part.lower() for part in _NAME.findall(token)]
    if len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST or STATE_ANY.intersection(words)):
        return []
    return words


class _Page:
    """What names put out on one page: the kind of name, whether a title or article stands inside, and whether the name is a vague one.

    A form is vague, as some pages are one form as a whole; so is a name that is part of a longer token (a page builder's
    "x-widget") or stands beside a name of the article. Vague names that most of the good text stands under tell nothing on this page. ``marked``: an article is marked outside all of these.
    """

    def __init__(self) -> None:
        self.comments: list[bool] = []
        self.holds: list[bool] = []
        self.vague: list[frozenset[str]] = []
        self.marked = False

    def enter(self, tag: str, raw: str, top: _Open) -> _Open:
        """What opening this element makes of the place: out, in the article, or a header that lends its headings only."""
        attributes = _attributes(raw) if raw.strip() else {}
        role = attributes.get("role", "").lower()
        tokens = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
        words = [_words(t) for t in tokens]
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        whole = tag in ("html", "body")
        main = tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop") == "articleBody"
        out = tag in OUT_TAGS or role in OUT_ROLES or hidden
        named = top.named
        if not out and not whole and tag not in HEADINGS and tag != "main":
            if tag == "article":
                hits = ARTICLE_OUT.intersection(t.lower() for t in tokens)
            else:
                hits = {w for ws in words for w in ws if w in OUT_NAMES or w in COMMENT_NAMES}
            form = tag == "form" or role == "form"
            if hits or form:
                named = (*named, len(self.holds))
                self.comments.append(bool(hits & COMMENT_NAMES))
                self.holds.append(False)
                plain = any(len(ws) == 1 and ws[0] in hits for ws in words) and not any(t.lower() in ARTICLE_NAMES for t in tokens)
                # A form speaks for itself alone, a name for all that bear it.
                self.vague.append(frozenset() if plain else frozenset(hits | ({f"form {len(self.vague)}"} if form else set())))
        if main or tag == "h1":
            for i in named:
                self.holds[i] = True
        if main and not out and not top.out and not named:
            self.marked = True
        heads = not whole and not main and (tag == "header" or role == "banner" or any(ws and ws[-1] in ("header", "masthead") for ws in words))
        return _Open(tag, top.out or out, (top.main or main) and not out, top.heads_only or heads, named)


def blocks(html: str) -> list[Block]:
    """The blocks of a page that are not out of the question, in page order, with the labels of the first pass."""
    found, page = _blocks(html)
    return _without_named(found, page)


def _blocks(html: str) -> tuple[list[Block], _Page]:
    found: list[Block] = []
    page, stack = _Page(), _Stack()
    parts: list[str] = []
    links = heading = in_link = 0
    unended: set[str] = set()

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        top = stack.open[-1]
        if text and not top.out and (not top.heads_only or top.main):
            lead = top.heads_only and not heading
            found.append(Block(text, min(links, len(text)), top.main, bool(heading), top.named, lead))
        parts.clear()
        links = 0

    def say(piece: str) -> None:
        nonlocal links
        if piece:
            text = unescape(piece)
            parts.append(text)
            if in_link:
                links += len(" ".join(text.split()))

    def beyond(tag: str, at: int) -> int:
        """Where the content of this element ends; ``at`` if it has no end tag and is not raw."""
        if tag not in unended:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if end:
                return end.start()
            unended.add(tag)
        return len(html) if tag in RAW_TAGS else at

    at = 0
    last_end = html.rfind(">")
    while at < len(html):
        m = _TOKEN.search(html, at) if at <= last_end or html.startswith("<!", at) else None
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in RAW_TAGS or tag in SKIPPED_TAGS:
            if not closing and not m[3].endswith("/"):
                at = beyond(tag, at)
            continue
        if tag in ("br", "img", "wbr", "input"):
            parts.append("" if tag == "wbr" else " ")
            continue
        if tag == "head":
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        block = _is_block(tag)
        if block:
            flush()
            in_link = in_link if not closing else 0
        if tag in VOID_TAGS:
            continue
        if closing:
            i = stack.last((tag,))
            if i and (block or i > stack.blocks[-1]):
                here, below = stack.open[i], stack.open[i - 1]
                if (here.out and not below.out) or here.named != below.named:
                    flush()
                heading = 0 if block else heading
                stack.cut(i)
            continue
        if block:
            heading = int(tag in HEADINGS)
            paragraph = stack.last(("p",))
            if paragraph:  # a block ends an open paragraph and what was left open inside it
                stack.cut(paragraph)
            if tag in _CLOSES:
                ended = stack.last(_CLOSES[tag])
                if ended > stack.last(_LIMITS[tag]):
                    stack.cut(ended)
            stack.push(page.enter(tag, m[3], stack.open[-1]))
        elif not m[3].endswith("/"):
            top = stack.open[-1]
            inner = page.enter(tag, m[3], top) if m[3].strip() else _Open(tag, top.out, top.main, top.heads_only, top.named)
            if inner.out != top.out or inner.named != top.named:
                flush()
            stack.push(inner)
    flush()
    return found, page


def _without_named(found: list[Block], page: _Page) -> list[Block]:
    """Blocks outside of what names put out; what holds most of the good text is no sidebar, whatever its name."""
    first_pass(found)
    good = [0] * len(page.holds)
    under: dict[str, int] = {}
    total = 0
    for b in found:
        if b.label > 0 and not any(page.comments[i] for i in b.named):
            total += len(b.text)
            for i in b.named:
                good[i] += len(b.text)
            for name in frozenset().union(*(page.vague[i] for i in b.named)):
                under[name] = under.get(name, 0) + len(b.text)
    free = frozenset() if page.marked else frozenset(name for name, size in under.items() if 2 * size > total)
    stays = [not page.comments[i] and ((page.holds[i] and 2 * good[i] > total) or (bool(page.vague[i]) and page.vague[i] <= free)) for i in range(len(good))]
    return [b for b in found if all(stays[i] for i in b.named) and not (b.lead and b.label < 0)]


def first_pass(found: list[Block]) -> None:
    """Labels from each block alone; left undecided are headings, blocks under ``LONG``, and longer ones without the page's stop words.

    Where no block has the stop words of a known language, long blocks are told by the ends of sentences. In the article,
    running text may have many links, but is not all link. What an article's own header says beside headings is
    good if it is running text (a lead, no byline).
    """
    shares = []
    for b in found:
        words = re.findall(r"[^\W\d_]+", b.text.lower())
        shares.append(sum(w in _STOPS for w in words) / max(1, len(words)))
    known = any(share >= STOPS_LOW and len(b.text) >= SHORT for share, b in zip(shares, found, strict=True))
    for share, b in zip(shares, found, strict=True):
        n = len(b.text)
        running = share >= STOPS_LOW and n >= SHORT
        if b.links > LINKS * n and not (b.main and running and b.links < LINKED * n):
            b.label = -1
        elif b.lead:
            b.label = 1 if running else -1
        elif b.heading or n < SHORT:
            b.label = 0
        elif n >= LONG:
            b.label = 1 if b.main or share >= STOPS_LOW or (not known and _SENTENCE.search(b.text)) else 0 if known else -1
        else:
            b.label = 1 if share >= STOPS_HIGH else 0


def second_pass(found: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided neighbours; equally near ones must both be bad to make it bad.

    Without any decided neighbour a block is good in the article, or where the page marks none.
    """
    n = len(found)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            near[i] = last
            if found[i].label:
                last = i
    labels = []
    for i, b in enumerate(found):
        label = b.label
        if not label:
            sides = [(abs(j - i), found[j].label) for j in (before[i], after[i]) if j is not None]
            least = min((d for d, _ in sides), default=0)
            votes = [v for d, v in sides if d == least]
            # In the article only what is good passes its label on, unless all around is bad.
            label = (1 if any(v > 0 for _, v in sides) or not sides else -1) if b.main else (1 if not votes or max(votes) > 0 else -1)
        labels.append(label)
    for b, label in zip(found, labels, strict=True):
        b.label = label


def main_text(html: str) -> str:
    """The main text of one page: its good blocks, joined by line ends."""
    found = blocks(html)
    if any(b.main for b in found):
        found = [b for b in found if b.main]
    second_pass(found)
    return "\n".join(b.text for b in found if b.label > 0)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Null and empty pages, and pages without a good block, have the text ''. Markup that is cut off or not
    closed is read as far as it goes; very long and deeply nested pages are read whole, in time that grows with
    their length. Repeated rows each get their text; an empty table gives an empty result; other
    columns are not looked at.
    """

    def make(rows):
        import pyarrow as pa

        return [pa.array([main_text(h) for h in rows], pa.string())]

    packed = pages.select(F.struct(F.col(id_col).alias("page_id"), "url").alias("page"), whole_text(html_col).alias("html"))
    out = per_text(packed.select(F.col("page").alias("doc_id"), F.col("html").alias("text")), make, "main string")
    return out.select("doc_id.page_id", "doc_id.url", F.col("main").alias("text"), F.length("main").cast("long").alias("n_chars"))
