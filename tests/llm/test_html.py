import random

import pytest

from barweave.llm.html import Block, extract, first_pass, main_text

PROSE = "This is the kind of running text that an article has, with many of the words that are in every text of the language, and it goes on for a while so that it is long enough to be decided on its own."


@pytest.mark.parametrize(
    "html,want",
    [
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just text", "just text"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{PROSE}<p>Short.</article><footer>&copy; us</footer>", f"T\n{PROSE}\nShort."),
        (f"<article><p>a  b\n&amp;&nbsp;c &eacute;<br>d</p><p>{PROSE}</p></article>", f"a b & c é d\n{PROSE}"),
        (f"<script>var t='</p><p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><article><p>{PROSE}</p></article>", PROSE),
        (f"<article><header><p>By us</p><h1>Title</h1></header><p>{PROSE}</p><aside>Aside {PROSE}</aside><form>Send <input></form></article>", f"Title\n{PROSE}"),
        (f"<div class='cookie-notice'>{PROSE}</div><div id=main-menu>x</div><main><p>{PROSE}</p></main><section id='comments'><article class=comment><p>{PROSE}</p></article></section>", PROSE),
        (f"<div class=content><p>{PROSE}</p><p>Well.</p><p>{PROSE}</p></div><div class=sidebar><p>{PROSE}</p></div>", f"{PROSE}\nWell.\n{PROSE}"),
        (f"<article><p>{PROSE}</p><ul><li><a href=a>One link of many</a><li><a href=b>And another link</a></ul><p>End.</p><p>{PROSE}</p></article>", f"{PROSE}\nEnd.\n{PROSE}"),
        (f"<article><p>{PROSE}</p><div class=ad>{PROSE}</div><p>Tail.</p></article>", f"{PROSE}\nTail."),
        ("<article><p>cut off <b>here", "cut off here"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<article><p>Only short.</p></article>", "Only short."),
        (f"<article><span class=share>Share</span><p>{PROSE}</p></article>", PROSE),
    ],
)
def test_pages(html, want):
    assert main_text(html) == want


def test_long_and_broken_pages():
    assert main_text("<article>" + "<p>x</p>" * 20000 + "</article>").count("\n") == 19999
    assert main_text("<div>" * 3000 + "deep") == "deep"
    main_text("<" * 20000)
    main_text("<a " + "x='" * 5000)


def test_on_spark(spark):
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>", "x"), (1, "u", f"<article><p>{PROSE}</p></article>", "x"), (2, None, None, "y"), (None, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract(pages).collect())
    assert got == [(0, "v", "", 0), (1, "u", PROSE, len(PROSE)), (1, "u", PROSE, len(PROSE)), (2, "", "", 0)]
    assert extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html",
    [
        f"<head><title>t</title><article><p>{PROSE}</p></article>",
        f"<html><head><meta charset=utf-8><title>t</title><header><h1>Site</h1></header><article><p>{PROSE}</article>",
        f'<div class="has-sidebar"><p>{PROSE}</p></div>',
        f'<div class="no-sidebar content"><p>{PROSE}</p></div>',
        f'<div class="with-comments post"><p>{PROSE}</p></div>',
        f'<article class="post tag-social"><p>{PROSE}</p></article>',
        f"<div class='content has-sidebar'><article><p>{PROSE}</p></article></div>",
        f"<article class='post comments-open'><p>{PROSE}</p></article>",
        f"<article class='post promoted'><p>{PROSE}</p></article>",
        f"<div class='tags-layout'><article><p>{PROSE}</p></article></div>",
        f"<div class='sidebar-page'><nav>n</nav><article><p>{PROSE}</p></article></div>",
        f"<div id=commentary><article><p>{PROSE}</p></article></div>",
        f"<script>if (a</scriptx>) b</script><article><p>{PROSE}</p></article>",
        f"<article><select><option>a<option>b</select><p>{PROSE}</p></article>",
        f"<app-shell class='layout-with-footer'><article><p>{PROSE}</p></article></app-shell>",
    ],
)
def test_pages_that_keep_their_article(html):
    assert main_text(html) == PROSE


def test_names_that_do_put_out():
    for name in ("sidebar", "left-sidebar", "siteFooter", "cookie-banner", "ad", "post-comments", "related-posts"):
        assert main_text(f"<div class=content><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div><div class='{name}'><p>{PROSE}</p></div>") == f"T\n{PROSE}\n{PROSE}", name
    assert main_text(f"<article><p>{PROSE}</p></article><div id=comments><article class=comment><p>{PROSE} {PROSE}</p></article></div>") == PROSE


def test_formulas_and_unknown_languages_stay():
    assert main_text(f"<article><p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == f"{PROSE} x=2 holds."
    other = "Tämä on pitkä kappale jossa ei ole yhtään tunnetun kielen sanaa. " * 5
    assert main_text(f"<div><p>{other}</p><div class=footer>{other}</div></div>") == other.strip()


def test_short_blocks_inherit_and_long_ones_do_not():
    found = [Block("x" * 30, 0, False, False), Block("qz " * 100, 0, False, False)]
    first_pass(found)
    assert [b.label for b in found] == [0, -1]


def test_deep_and_hostile_pages_take_time_by_their_length():
    import time

    def seconds(html):
        start = time.perf_counter()
        main_text(html)
        return time.perf_counter() - start

    for make in (lambda n: "<div>" * n + "deep", lambda n: "<li>" + "<div>" * n + "<li>" * n, lambda n: "<button>" * n + "x", lambda n: "<a '" * n + ">", lambda n: "<p>" + "<b>" * n + "</i>" * n):
        seconds(make(1000))
        assert seconds(make(16000)) < 24 * max(seconds(make(2000)), 0.01)


WORDS = [f"{a}{b}" for a in ("ver", "lan", "mor", "sti", "gar") for b in ("ten", "ily", "osk", "um")]
OUTSIDE = ("<nav><ul><li><a href=x>{}</a></ul></nav>", "<aside><p>{}</p></aside>", "<div class=ad><p>{}</p></div>", "<form>{}<input></form>", "<script>var x = '<p>{}</p>';</script>", "<!-- {} -->", "<style>p::after {{ content: '{}' }}</style>", "<div role=navigation>{}</div>", "<div hidden>{}</div>", "<footer>{}</footer>", "<section id=comments><p>{}</p></section>", "<svg><text>{}</text></svg>")


def generated(rng):
    """A page and its main text, known as the page is put together: a plain walk over what it is made of."""

    def prose():
        return " ".join(rng.choice(("the", "and", "of", "to", "in", "that", "with", "as")) if rng.random() < 0.45 else rng.choice(WORDS) for _ in range(rng.randrange(40, 90)))

    def marked(text):
        """The text with markup and references in it, which say the same."""
        out = []
        for word in text.split():
            draw = rng.random()
            if draw < 0.05:
                word = f"<b class=has-ads>{word}</b>"
            elif draw < 0.1:
                word = f"<a href='/x?a=1&amp;b=2'>{word}</a>"
            elif draw < 0.15:
                word = "".join(f"&#{ord(c)};" for c in word)
            elif draw < 0.2:
                word = f"<!-- {word} -->{word}"
            out.append(word)
        return rng.choice((" ", "\n\t", " &nbsp;", "<br>")).join(out)

    parts, want = [], []
    for _ in range(rng.randrange(3, 12)):
        draw = rng.random()
        text = prose()
        if draw < 0.3:
            parts.append(rng.choice(OUTSIDE).format(prose()))
            continue
        want.append(text)
        if draw < 0.5:
            parts.append(f"<p>{marked(text)}")
        elif draw < 0.6:
            parts.append(f"<blockquote><p>{marked(text)}</p></blockquote>")
        elif draw < 0.7:
            items = [prose() for _ in range(3)]
            want += items
            parts.append(f"<p>{marked(text)}<ul>" + "".join(f"<li>{marked(i)}" for i in items) + "</ul>")
        elif draw < 0.8:
            parts.append(f"<table><tr><td>{marked(text)}<tr><td></table>")
        else:
            parts.append(f"<div class='{rng.choice(('text', 'has-sidebar', 'post-body'))}'><p>{marked(text)}</p></div>")
    before, after = ("".join(rng.choice(OUTSIDE).format(prose()) for _ in range(rng.randrange(3))) for _ in range(2))
    head = rng.choice(("<html><head><title>x</title></head><body>", "<head><title>x</title>", ""))
    return f"{head}{before}<article>{''.join(parts)}</article>{after}", "\n".join(want)


def test_generated_pages_against_what_they_are_made_of():
    rng = random.Random(6)
    for _ in range(300):
        html, want = generated(rng)
        assert main_text(html) == want, html


ONE = "The committee said on Tuesday that the plan for the new bridge would be put to the vote after the summer, as most of its members had asked for more time with it and for a second opinion on what it would cost the town."
TWO = "If it is passed, the work could begin in the spring of the next year, and the bridge would be open to all who want to use it by the time that the old one has to be closed, which is what they had hoped for from the start of it all."
NAMES = "Aalto Virtanen, Eino Korhonen, Toivo Nieminen, Urho Laine, Veikko Salonen, Onni Heikkinen, Paavo Rantanen, Kalevi Jokinen, Reino Tuominen, Martti Lehtonen, Erkki Saarinen, Lauri Heinonen, Pentti Niemi"
BOTH = f"{ONE}\n{TWO}"
MENU = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>"
FOOT = "<footer>All rights reserved. Do not copy any of this.</footer>"


@pytest.mark.parametrize("body, want", [
    (f'<form id="aspnetForm" action="x"><input type=hidden>{MENU}<div><p>{ONE}</p><p>{TWO}</p></div>{FOOT}</form>', BOTH),
    (f"<form><article><p>{ONE}</p><p>{TWO}</p></article></form>", BOTH),
    (f'{MENU}<div class="elementor-widget elementor-widget-text"><div class="elementor-widget-container"><p>{ONE}</p><p>{TWO}</p></div></div>{FOOT}', BOTH),
    (f'<div class="elementor-widget"><h1>The new bridge</h1></div><div class="elementor-widget"><div class="elementor-widget-container"><p>{ONE}</p><p>{TWO}</p></div></div>', f"The new bridge\n{BOTH}"),
    (f'<div class="x-widget x-widget-heading"><h2>The new bridge</h2></div><div class="x-widget x-widget-text"><p>{ONE}</p><p>{TWO}</p></div><div class="x-widget x-widget-related-posts"><p>{ONE[:90]}</p></div>', f"The new bridge\n{BOTH}"),
    (f'<div class="notice-board-page"><p>{ONE}</p><p>{TWO}</p></div>', BOTH),
    (f'<div class="post tags"><p>{ONE}</p><p>{TWO}</p></div>', BOTH),
    (f"{MENU}<div><p>{ONE}</p><p>{NAMES}</p><p>{TWO}</p></div>{FOOT}", f"{ONE}\n{NAMES}\n{TWO}"),
    (f"<article><p>{ONE}</p><p>{TWO[:60]}<a href=x>{TWO[60:180]}</a>{TWO[180:]}</p></article>", BOTH),
    (f"<article><header><h1>The new bridge</h1><p>By A. Writer</p><p>{ONE}</p></header><p>{TWO}</p></article>", f"The new bridge\n{BOTH}"),
])
def test_ordinary_layouts_keep_the_article(body, want):
    assert main_text(f"<html><body>{body}</body></html>") == want


@pytest.mark.parametrize("body, want", [
    (f"<article><p>{ONE}</p></article><form><p>Write to us if you have any questions about this, or if there is more that you would like to know from us and from all who work with us on it, as we will be glad to be of help to you.</p><input></form>", ONE),
    (f'<article><p>{ONE}</p></article><div class="sidebar-widget"><p>{TWO}</p><p>{TWO}</p></div>', ONE),
    (f'<div><p>{ONE}</p><p>{ONE}</p></div><div class="related-posts"><p>{TWO}</p></div>', f"{ONE}\n{ONE}"),
    (f'<div class="sidebar"><p>{ONE}</p></div>', ""),
    (f"<article><p>{ONE}</p><p><a href=x>{TWO}</a></p></article>", ONE),
    (f'<div class="comment-list"><p>{ONE}</p></div>', ""),
])
def test_what_is_no_article_stays_out(body, want):
    assert main_text(f"<html><body>{body}</body></html>") == want
