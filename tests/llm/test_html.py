"""Whole articles of pages without <article>, and implied end tags."""

import random
import re
import time

import pytest

from catalume.llm import html

LONG = "A long quotation that holds most of the text of this page, and more than all its other lines do together."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div id=c><h1>T</h1><p>One two.</p><blockquote>{LONG}</blockquote><p>Three.</p></div>", f"T One two. {LONG} Three."),
        (f"<div><div><p>{LONG}</p></div><div><p>Short end.</p></div></div>", f"{LONG} Short end."),
        (f"<div><p>Start.</p><table><tr><td>{LONG}<td>b<tr><td>c</table></div>", f"Start. {LONG} b c"),
        (f"<main><article><p>{LONG}</p></article><article><p>Second.</p></article></main>", f"{LONG} Second."),
        ("<div><p class=notice>We use<p>Real text of it.<ul><li class=ad>Buy<li>kept</ul></div>", "Real text of it. kept"),
        ("<div><ul><li>a<ul><li>b</ul>c<li>d</ul><dl><dt class=ad>x<dd>y</dl></div>", "a b c d y"),
    ],
)
def test_html_whole_articles(page, want):
    assert html.main_text(page) == want


TEXT = "A paragraph of the article that is long enough to be told from menus, which are short and full of links."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # regions of links without any mark are told by their ratio alone, short lines without links stay
        (f"<div><div><a href=a>One</a> <a href=b>Two</a></div><div><h1>T</h1><p>{TEXT}</p><p>Short.</p></div></div>", f"T {TEXT} Short."),
        (f"<main><div><a href=a>Back to the list of all entries</a></div><div><p>{TEXT}</p></div><div>End</div></main>", f"{TEXT} End"),
        # names of containers do not count around the title, nor where nothing else is left
        (f"<div class='notice-board'><h1>Title</h1><p>{TEXT}</p></div>", f"Title {TEXT}"),
        (f"<div class=overlay><p>{TEXT}</p></div>", TEXT),
        (f"<article><p>{TEXT}</p></article><section class=comments><article class=comment><p>{TEXT} {TEXT}</p></article></section>", TEXT),
        ('<article><p class="ad">Buy now<p>Real text.</article>', "Real text."),
        (f"<article><p>{TEXT} <span class=ad>Buy</span> more</p><ul><li class=share>x<li>kept</ul></article>", f"{TEXT} more kept"),
        (f"<b><div><p>{TEXT}</b> on</p></div>", f"{TEXT} on"),
    ],
)
def test_html_regions(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><form id=aspnetForm><article><p>{TEXT}</p></article></form><div>(c) 2020</div></body>", TEXT),
        (f"<body><form><input><label>Name</label></form><div><p>{TEXT}</p></div></body>", TEXT),
        (f'<article><h1>T</h1><div class="social-history"><p>{TEXT}</p></div></article>', f"T {TEXT}"),
        (f'<article><h2 class="menu">The menu</h2><p id="comments">{TEXT}</p></article>', f"The menu {TEXT}"),
        (f"<article><p>{TEXT}</p><div class=share><a href=a>Share</a> it</div></article>", TEXT),
        (f"<article><p>{TEXT}</p><div class=comments><p>{TEXT} {TEXT}</p></div></article>", TEXT),
        (f"<div><p>{TEXT}</p></div><div class=sidebar><p>{TEXT}</p></div>", TEXT),
    ],
)
def test_html_words_and_forms_are_evidence(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("piece", ["<a ", "<!--", '<a href="', "<![", "<?", "</", '<a b="x>', "<script>", "<title>", "&#", "<a href='\""])
@pytest.mark.parametrize("end", ["", ">", "\"'>-->"])
def test_html_unclosed_pieces_take_linear_time(piece, end):
    began = time.process_time()
    assert html.main_text(f"<article><p>{TEXT}</p></article>" + piece * 20_000 + end).startswith(TEXT)
    html.main_text(piece * 20_000 + end)
    assert time.process_time() - began < 2


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("a <b title='x > y'>c</b> d", "a <b title='x > y'>c</b> d"),
        ("a < b <3 <c", "a &lt; b &lt;3 &lt;c"),
        ("x<!-- > <p> -->y<!DOCTYPE html>z<![CDATA[1]]>", "xyz"),
        ("<p class=it's>q \"r\" s</p>", "<p class=it&#39;s>q \"r\" s</p>"),
        ("<script>if (a<b) '<!--'</script>t<style>", "<script></script>t<style>"),
        ("<a href=\"x>y</a> z", "<a href=&quot;x>y</a> z"),
        ("<!-- no end <p>x</p>", " no end <p>x</p>"),
    ],
)
def test_html_complete(page, want):
    assert html.complete(page) == want


def made_page(rng, n):
    """A page without article tags or telling names: a list of links, paragraphs, short lines, a foot."""
    links = "".join(f"<li><a href=p{i}>{' '.join(rng.choices(['Home', 'News', 'Shop', 'About us', 'Contact'], k=2))}</a></li>" for i in range(rng.randrange(3, 9)))
    words = ["the", "river", "old", "stone", "walks", "under", "a", "grey", "sky", "and", "waits"]
    body = "".join(f"<p>{' '.join(rng.choices(words, k=rng.randrange(15, 50)))}.</p>" for _ in range(rng.randrange(2, 6)))
    foot = "".join(f"<a href=f{i}>{rng.choice(['Terms', 'Privacy', 'Imprint'])}</a> " for i in range(3))
    return f"<body><div><ul>{links}</ul></div><div><h1>Page {n}</h1>{body}</div><div>{foot}All rights reserved {n}</div></body>"


def test_html_ratios_decide_on_made_pages(monkeypatch):
    """Without article tags and names the clusters of ratios choose: without a threshold most of such pages come out otherwise."""
    rng = random.Random(2)
    pages = [made_page(rng, n) for n in range(60)]
    want = [re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", p[p.index("<h1>") : p.rindex("</p>")])).strip() for p in pages]
    found = [html.main_text(p) for p in pages]
    assert sum(a == b for a, b in zip(found, want)) == len(pages)
    monkeypatch.setattr(html, "split_level", lambda values: float("-inf"))
    assert sum(html.main_text(p) != a for p, a in zip(pages, found)) > 0.9 * len(pages)


def test_html_threshold_decides(monkeypatch):
    page = f"<div><div><a href=a>One</a> <a href=b>Two</a></div><div><p>{TEXT}</p></div></div>"
    assert html.main_text(page) == TEXT
    monkeypatch.setattr(html, "split_level", lambda values: float("-inf"))
    assert html.main_text(page) == f"One Two {TEXT}"


@pytest.mark.parametrize("piece", ["<div>", "<p>", "<b>", "<li>", "<a><div>", "</p>", "<td><b>", "<span hidden><i>"])
def test_html_broken_pages_take_linear_time(piece):
    began = time.process_time()
    html.main_text("<button>" + "<b>" * 20_000 + (piece + "x") * 20_000 + "</i></p>" * 20_000)
    html.main_text("<article>" + (piece + "x ") * 20_000)
    assert time.process_time() - began < 20
