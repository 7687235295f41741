"""Main text: the scan against brute force, pages that no rule of the training pages made, hostile and odd markup."""

import random
import re
import time

import pyarrow.parquet as pq
import pytest

from quarry.llm import html_labels, html_text


def test_best_run_against_brute_force():
    r = random.Random(2)
    for _ in range(400):
        score = [r.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0, 4.0]) for _ in range(r.randint(0, 14))]
        runs = [(-sum(score[a:b]), a, b) for a in range(len(score)) for b in range(a + 1, len(score) + 1) if sum(score[a:b]) > 0]
        low, high = html_text.best_run(score)
        if not runs:
            assert (low, high) == (0, 0)
        else:
            best = min(runs)[0]
            assert -sum(score[low:high]) == best
            # the first run of that sum to end, and no shorter one ends there
            assert high == min(b for x, _, b in runs if x == best) and low == max(a for x, a, b in runs if x == best and b == high) or score[low] > 0


def test_pages_of_the_tables():
    """The article element of the driver's pages, cut out by a pattern."""
    plain, model = html_text.PageModel({}, 0.0), html_text.model()
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for row in rows:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", row["html"], re.S)[1]
        assert model.text(row["html"]) == plain.text(inside)
    assert len(rows) > 100


A = "The council met on Tuesday to discuss the new bridge over the river. Members spoke for two hours before they voted."
B = "Work begins in spring, the mayor said, and will take about a year; until then the old road stays open to all traffic."
C = "Short end."
HOSTILE = {
    "open tags": "<script " * 130_000, "scripts": "<script>" * 130_000, "quotes": '<p title="' * 100_000, "both quotes": "<p a='" * 80_000 + '>"', "comments": "<!--" * 250_000, "angles": "<" * 1_000_000, "heads": "<head " * 160_000,
    "titles": "<title>" * 140_000, "equals": "<p " + "=" * 900_000 + ">", "attributes": "<p " + "a = " * 250_000, "spaces": "<p " + " " * 990_000, "ends": "</p " * 250_000, "paragraphs": "<p><b>" * 60_000 + "<div>" * 60_000, "crossed": "<b><i>" * 80_000 + "</b>" * 80_000, "references": "&" * 1_000_000, "names": '<p class="' + "aB" * 490_000 + '">x',
}


@pytest.mark.parametrize("page, want", [
    (f"<body><div id=top><a href=/>Home</a> <a href=/n>News</a></div><div class='post-body'><h1>Bridge vote</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div id=sidebar><p>Read also: ten things to do this summer in town</p></div></body>", f"Bridge vote {A} {B} {C}"),
    (f"<table><tr><td class=menu><a href=a>One</a><br><a href=b>Two</a></td><td><p>{A}</p><p>{B}</p></td></tr></table><div class=footer>All rights reserved by nobody in particular</div>", f"{A} {B}"),
    (f"<main><p>{A}</p><form action=s><label>Mail</label><input><button>Send</button></form><p>{B}</p><section class='comments'><p>{A} {A}</p></section></main>", f"{A} {B}"),
    (f"<form id=aspnetForm><nav>Home News</nav><article><p>{A}</p></article></form>", A),
    (f"<article><header><h1>Bridge vote</h1></header><p>{A}</p><aside>Advice for readers of this page</aside><p>{C}</p></article>", f"Bridge vote {A} {C}"),
    ("<p title=it's>Hello world</p><p>it's more</p>", "Hello world it's more"),
    ("<article><p>one two three four five</p><div class=comments><p>a reader speaks at great length here</p></div><p>six seven</p></article>", "one two three four five six seven"),
    ("<article><p>one two three four five</p><p class=text-share>six seven</p></article>", "one two three four five six seven"),
    ("<article><p>one <math><mi>x</mi></math> two <noscript>three</noscript> <svg class=i/> <canvas>four</canvas></p></article>", "one x two three four"),
    ("<p>all of <textarea>typed</textarea> these words", "all of these words"), ("<p a=\"x>unclosed words here</p><p>more</p>", "unclosed words here more"), ("<p>cut <a href=\"x", "cut"),
    ("<p>a <!-> b <!--> c <!---> d", "a b c d"), ("<p>1 </ 2> 3 <3 <é", "1 3 <3 <é"), ("<title>never closed<p>but this stays", "but this stays"), ("<p><b>open <i>all</b> the </i>way", "open all the way"),
    ("<p class=ad>buy this<p>read these words that stand before it<ul><li class=ad>buy<li>and these are words of the list as well</ul>", "read these words that stand before it and these are words of the list as well"), ("<head><p>stays</p>", "stays"),
])
def test_pages_by_hand(page, want):
    assert html_text.model().text(page) == want


@pytest.mark.parametrize("page, want", [
    (f'<article class="en"><h1>T</h1><p>{A}</p></article>', f"T {A}"),
    (f'<article><div class="lang en"><p>{A}</p></div><div class="lang fr"><p>{B}</p></div></article>', f"{A} {B}"),
    (f'<article><p>{A}</p><section id="related-work"><p>{B}</p></section></article>', f"{A} {B}"),
    (f'<article><p>{A}</p><section id="search-algorithms"><p>{B}</p></section></article>', f"{A} {B}"),
    (f'<article><p>{A}</p><div class="author-interview"><p>{B}</p></div></article>', f"{A} {B}"),
    (f"<article><p>{A}</p><p>Press the <button>Send</button> key to go on.</p></article>", f"{A} Press the Send key to go on."),
    (f'<div class="sidebar-layout"><article><p>{A}</p></article></div>', A),
    (f'<div class="sidebar"><main><p>{A}</p></main></div>', A),
    (f'<main><p>{A}</p><ol class="comment-list"><li>{B} {B} {B}</li></ol></main>', A),
    (f'<main><p>{A}</p><div class="comments x7fa"><p>{B} {B}</p></div></main>', A),
    (f'<main><p>{A}</p><button>Share</button><p>{B}</p></main>', f"{A} {B}"),
    (f'<main><p>{A}</p><div class="social-links"><a>{B}</a></div></main>', A),
])
def test_names_that_only_seem_to_tell(page, want):
    assert html_text.model().text(page) == want


def test_no_chance_name_cuts_an_article():
    """Every word of the training pages' text as the name of an article."""
    model = html_text.model()
    words = {w for page in html_labels.pages(60) for markup, _ in page for w in re.sub("<[^>]*>", " ", markup).lower().split() if w.isalpha()}
    words -= set(" ".join(html_labels.BESIDE.values()).split())  # names that pages do give to menus and the like
    assert len(words) > 2000
    for w in words:
        assert model.text(f'<body><div class="{w}"><h1>T</h1><p>{A}</p></div></body>') == f"T {A}"


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    model, page = html_text.model(), HOSTILE[name]
    start = time.process_time()
    model.text(page)
    assert time.process_time() - start < 2


def test_long_page_is_read_whole():
    page = "<article>" + f"<p>{A}</p><p>{B}</p>" * 5000 + "</article>"
    assert html_text.model().text(page) == " ".join([A, B] * 5000)
