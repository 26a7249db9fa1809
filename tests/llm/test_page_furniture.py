"""What of a page is furniture, and pages that are copies of one another."""

from __future__ import annotations

import pytest

from mediaflow.llm import boilerplate
from mediaflow.llm.markup import ARTICLE, FURNITURE, blocks


@pytest.mark.parametrize(
    "attribute",
    ['class="article-comments"', 'class="content-ad"', 'class="main-menu"', 'class="article-share"', 'class="related-article"',
     'class="discussion"', 'id="feedback-list"', 'class="x commentList"', 'id="textAd"', 'class="article-footer"'],
)
def test_furniture_inside_an_article_goes(attribute):
    found = blocks(f"<article><p>Own text</p><div {attribute}><p>Not of it</p></div><p>More</p></article>")
    assert [(b.kind, b.text) for b in found] == [(ARTICLE, "Own text"), (FURNITURE, "Not of it"), (ARTICLE, "More")]


@pytest.mark.parametrize(
    "element",
    ["<header><h1>Title</h1></header>", '<div class="article-header"><h1>Title</h1></div>', '<div class="entry-header">Title</div>',
     '<div class="no-sidebar">Title</div>', '<div class="content-with-menu">Title</div>', '<div class="article-body">Title</div>', '<div class="main-text">Title</div>'],
)
def test_what_an_article_is_made_of_stays(element):
    found = blocks(f"<header>Site</header><article>{element}<p>Text</p><footer>By me</footer></article>")
    assert [(b.kind, b.text) for b in found] == [(FURNITURE, "Site"), (ARTICLE, "Title"), (ARTICLE, "Text"), (FURNITURE, "By me")]


def test_copies_of_a_page_keep_their_text(spark):
    body = "<div>a text that stands under three ids of one host, nine words and more</div>"
    note = "<div>accept our terms of use before you read any further on this site</div>"
    rows = [(i, "http://h.example/x", body) for i in range(3)] + [(3, "http://h.example/y", body)] * 2
    rows += [(10 + i, None, f"{note}<p>own{i}</p>") for i in range(4)] + [(20 + i, "/relative", f"{note}<p>own{i}</p>") for i in range(4)]
    rows += [(30 + i, f"http://many.example/{i}", f"{note}<p>own{i}</p>") for i in range(3)] + [(40 + i, f"http://two.example/{i % 2}", f"{note}<p>own{i % 2}</p>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in boilerplate.main_text(pages).collect()}
    said = "accept our terms of use before you read any further on this site"
    assert {found[i] for i in range(4)} == {body[5:-6]}
    assert all(found[i].startswith(said) for i in [*range(10, 14), *range(20, 24)])
    assert [found[30 + i] for i in range(3)] == [f"own{i}" for i in range(3)]
    # On two pages only, though these stand there six times.
    assert all(found[40 + i] == f"{said}\n\nown{i % 2}" for i in range(6))
