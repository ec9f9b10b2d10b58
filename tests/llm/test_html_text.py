"""Minimum cuts against all labellings; pages of several makes against the text a reader would keep."""

import html
import itertools
import random
import re

import pytest

from creatorlake.llm import QUERIES, html_text


def test_cut_equals_all_labellings():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 9)
        scores = [rng.choice([-2, -1, -0.5, 0, 0.5, 1, 2, 3]) + rng.random() / 100 for _ in range(n)]
        edges = [(i, j, rng.random() * 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]

        def cost(labels):
            lost = sum(abs(s) for s, x in zip(scores, labels) if x != (s > 0))
            return lost + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(html_text.minimum_cut(scores, edges)) - best) < 1e-6


def test_flow_separates_a_long_undecided_chain():
    """No node outweighs its edges, so nothing is settled first."""
    scores = [0.3] * 400 + [-0.3] * 300 + [0.2] * 50
    edges = [(i, i + 1, 1.0) for i in range(len(scores) - 1)]
    assert html_text.minimum_cut(scores, edges) == [True] * 400 + [False] * 300 + [True] * 50
    scores = [0.3] * 400 + [-0.3] * 6 + [0.2] * 50 + [-0.3] * 9 + [0.01] * 80
    edges = [(i, i + 1, 1.0) for i in range(len(scores) - 1)]
    assert html_text.minimum_cut(scores, edges) == [True] * 456 + [False] * 89


STORY = ("The ferry left at noon, and nobody on the pier had noticed the storm.", "It came up from the south within the hour.", "Ok.",
         "By evening the harbour was closed and the lights along the quay went out one by one.")
WANT = "Storm at sea " + " ".join(STORY)
BODY = "".join(f"<p>{p}</p>" for p in STORY)
MENU = "<ul><li><a href=/>Home</a><li><a href=/n>News from the whole region and beyond.</a><li><a href=/s>Sport</a></ul>"
PAGES = {
    "sections": f"<body><header><h2>The Daily Wave</h2></header><nav>{MENU}</nav><main><h1>Storm at sea</h1>{BODY}</main>"
                "<aside><p>Ten things that nobody told you about knots, and the last will surprise you.</p></aside>"
                "<footer><p>All rights are reserved by the publisher of this newspaper.</p></footer>",
    "classes": f"<div id=header><h2>The Daily Wave</h2></div><div class='top-menu'>{MENU}</div><div class=content><h1>Storm at sea</h1>{BODY}</div>"
               "<div class=sideBar><p>Subscribe to our letter today, and never miss a storm.</p></div>"
               "<div id=comments><div class=comment><p>I was there, and it was far worse than this article says it was.</p></div></div>",
    "inside": f"<article class='post has-sidebar'><header><h1>Storm at sea</h1></header><p>{STORY[0]}</p>"
              "<div class=ad><p>Buy our new and very waterproof boots, now cheaper than ever before.</p></div>"
              f"<p>{STORY[1]}</p><form><p>Leave your address, so that we may write to you every single day.</p></form><p>{STORY[2]}</p>"
              f"<div class='cookie-notice'>We use cookies to make this site work better for you.</div><p>{STORY[3]}</p>"
              "<section class=comments><article><p>I was there, and it was far worse than this article says it was.</p></article></section></article>",
    "unclosed": f"<html><head><title>Wave</title><nav>{MENU}</nav><article><h1>Storm at sea<p><b>" + "<p>".join(STORY),
    "tables": f"<table><tr><td>{MENU}<td><div id=story><h1>Storm at sea</h1>{BODY}</div></table>",
    "no marks": f"<div><div>{MENU}</div><div><h1>Storm at sea</h1>{BODY}</div></div>",
    "scripts": "<script>if (a</b>0) x='<p>no</p>'</SCRIPT ><style>p{}</style><noscript><p>Please turn on scripts, they are needed here.</p></noscript>"
               f"<!-- <p>not this</p> --><main><h1>Storm at sea</h1>{BODY}<textarea><p>nor this one, ever.</p></textarea><!-- open <p>end</p></main>",
    "form around": f"<form id=aspnet><nav>{MENU}</nav><article><h1>Storm at sea</h1>{BODY}</article></form>",
    "role": f"<div role=navigation>{MENU}</div><div role=main><h1>Storm at sea</h1>{BODY}<p hidden>Not to be seen by anybody who reads the page.</p></div>",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert " ".join(html_text.main_blocks(PAGES[name])) == WANT


@pytest.mark.parametrize("page, want", [
    ("", ""), ("   \n", ""), ("<", ""), ("<p", ""), ("</", ""), ("<p>a &lt;b&gt; &copy &#233;&#x1F600;&nbsp;c&unknown; d&amp;amp; done now.</p>",
                                                      "a <b> © é😀 c&unknown; d&amp; done now."),
    ("<p>one<b>two</b> three<br>four  five\n six and so on.</p>", "onetwo three four five six and so on."),
    ("A plain text that has no markup whatever, and 1 < 2.", "A plain text that has no markup whatever, and 1 < 2."),
    ("<article><p title='a > b'>Quoted signs do not end a tag, as is well known.</p><p a=\"open", "Quoted signs do not end a tag, as is well known."),
    ("<article></article></div></p></nav><ul></ul>", ""), ("<nav><p>Only a menu is to be found on this page.</p></nav>", ""),
])
def test_markup(page, want):
    assert " ".join(html_text.main_blocks(page)) == want


def test_hostile_pages_stay_linear():
    for page in ("<div>" * 50_000 + "Deep down there is a text to be read." + "</div>" * 50_000, "<a '" * 50_000, "<!--" * 50_000, "</p>" * 50_000,
                 "<p>" * 50_000, "<script>" * 20_000, "<b><i>" * 20_000 + "x", "<a>y" * 20_000, "<table><td><li>" * 10_000, "&" * 100_000):
        html_text.main_blocks(page)
    texts = [f"Sentence number {i} of a page that is very long." for i in range(20_000)]
    assert html_text.main_blocks("<article>" + "".join(f"<p>{t}" for t in texts)) == texts


def test_irregular_rows(spark):
    rows = [(k % 3, p, "clash", 1, "x") for k, p in enumerate([None, "", *PAGES.values(), None, ""])]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, row int, found string")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "html", "row", "found", "text", "n_chars", "n_blocks"]
    for r in got.collect():
        want = WANT if r["html"] else ""
        assert (r["text"], r["n_chars"], r["n_blocks"]) == (want, len(want), 5 if want else 0)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_query(spark, sf_dir):
    """The supplied pages keep their article in one element: read here by pattern, from whole pages."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op11_html_extraction"](spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        inside = re.search("<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", re.sub("</?(?:p|h1)>", " ", inside)))).split())
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))
