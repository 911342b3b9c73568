import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest


from tidewheel.llm import html

BODY = "One long sentence that is surely part of the main text of this page, with many words in it."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a &amp; b&nbsp;&lt;c&gt;</p>", "a & b <c>"),
        ("<article><h1>T</h1><p>one\n  two<br>three<p>four</article><footer>f</footer>", "T\n\none two three\n\nfour"),
        ("<nav>menu</nav><article>x</article>", "x"),
        ("<article><p>x<script>var a='</p><p>no';</script> y</p><!-- <p>z</p> --></article>", "x y"),
        ("<style>p{}</style><title>t</title><main><p>in</p><aside>side</aside></main><p>out</p>", "in"),
        ("<div class=ad>buy<article><p>text</p></article>", "text"),
        ("<article><p>x</p><div class='reader-comments'><p>troll</p><div>more</div></div><p>y</p></article>", "x\n\ny"),
        ("<article><p>x</p><section id=comments><p>troll</p></section></article>", "x"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<article><p title='a>b'>x</p></article>", "x"),
        ("<article>x<form><input value=a>f</form></article>", "x"),
        ("<article>cut here &am", "cut here &am"),
        ("<article>cut <a href='", "cut"),
        ("<article><p>As.</p><p>Be.</p></article>", "As.\n\nBe."),
        ("<script>never closed <p>x</p>", ""),
        ("<div hidden>no</div><article><span style='display:none'>no</span>yes</article>", "yes"),
        ("<div role=navigation>no</div><article>yes</article>", "yes"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<script>for(i=0;i<n;i++){f(i)}</script><article><p>x</p></article>", "x"),
        ("<article><p>x</p><script>if(a<b && c=='>\"')</SCRIPT ><p>y</p></article>", "x\n\ny"),
        ("<div class='share-price'><p>out</p></div><article><div class='share-price'>up</div><section id='login-history'>in</section></article>", "up\n\nin"),
        ("<article><p>x</p><div class='social-share'>s</div><div class='commentList'>c</div></article>", "x"),
        ("<article>&#233;&#x1F600;&copy</article>", "é😀©"),
    ],
)
def test_extract(page, want):
    assert html.extract(page) == want


def test_without_an_article_text_surges_and_dives():
    menu = "".join(f"<li><a href='{i}'>link number {i}</a></li>" for i in range(12))
    page = f"<ul>{menu}</ul><div><p>{BODY}</p><p>{BODY}</p></div><ul>{menu}</ul>"
    assert html.extract(page) == f"{BODY}\n\n{BODY}"


def test_text_outside_articles_surges_only_if_it_outweighs_them():
    article = f"<article><p>{BODY}</p><p>{BODY}</p></article>"
    assert html.extract(f"<div><p>{BODY}</p></div>{article}") == f"{BODY}\n\n{BODY}"
    paragraphs = "<p>" + " ".join([BODY] * 9) + "</p>"
    found = html.extract(f"<div>{paragraphs * 4}</div><article><p>teaser</p></article>")
    assert found.startswith(BODY) and found.count(BODY) == 36


def test_links_between_text_stay_and_at_its_ends_go():
    page = f"<a href=0>skip</a><p>{BODY}</p><p><a href=1>a link</a></p><p>{BODY}</p><p><a href=2>next page</a></p>"
    assert html.extract(page) == f"{BODY}\n\na link\n\n{BODY}"


@pytest.mark.parametrize(
    "page, want",
    [
        # Without an end of its own, an element that is no part goes up to its first block.
        (f"<div class=ad>buy <p>now</p><p>{BODY}</p>", f"now\n\n{BODY}"),
        (f"<p class=ad>buy<p>{BODY}</p>", BODY),
        (f"<article><div><aside>side</div><p>{BODY}</p></article>", BODY),
        # What is named like a sidebar may hold the page; text in it counts as elsewhere.
        (f"<div class='no sidebar'><article><p>{BODY}</p><p>end</p></article></div>", f"{BODY}\n\nend"),
        (f"<article><p>{BODY}</p></article><div class=related><article>teaser</article></div>", BODY),
        (f"<article><p>x</p><ul class=related><li>1<li>2<li>3<li>4</ul><p>y</p></article>", "x\n\ny"),
    ],
)
def test_elements_without_an_end_and_names_around_articles(page, want):
    assert html.extract(page) == want


class Blocks(HTMLParser):
    """What the test tables' pages hold, by the standard library's parser: blocks of the article."""

    def __init__(self):
        super().__init__()
        self.depth, self.parts, self.blocks = 0, [], []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1", "h2", "ul", "li", "div", "table", "tr", "td"):
            self.cut()
        if tag == "br":
            self.parts.append(" ")
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1", "h2", "ul", "li", "div", "table", "tr", "td"):
            self.cut()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_against_another_parser_and_without_marks():
    pages = [p or "" for p in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()]
    same = bare = 0
    for page in pages:
        parser = Blocks()
        parser.feed(page)
        parser.close()
        parser.cut()
        want = "\n\n".join(parser.blocks)
        same += html.extract(page) == want
        bare += html.extract(re.sub(r"<(/?)article\b", r"<\1div", page)) == want
    assert same == len(pages)
    assert bare >= 0.9 * len(pages)


def test_long_pages_are_kept_whole():
    page = "<article>" + "".join(f"<p>{i} {BODY}</p>" for i in range(5000)) + "</article>"
    assert html.extract(page).count("\n\n") == 4999
    assert html.extract("<" * 20000 + "<article>x</article>").endswith("x")
    assert html.extract("<div class=ad><p>" * 20000 + "y<p>x").endswith("x")
    assert html.extract("<article>" * 20000 + "<b>x").endswith("x")


def test_column(spark):
    rows = [(1, None), (2, "<article>x</article>"), (2, "<article>x</article>")]
    df = spark.createDataFrame(rows, "page_id int, html string").selectExpr("*", "'clash' text")
    found = df.select("page_id", html.main_text(df["html"]).alias("t"), "text").collect()
    assert sorted(map(tuple, found)) == [(1, "", "clash"), (2, "x", "clash"), (2, "x", "clash")]
    assert df.limit(0).select(html.main_text(df["html"])).collect() == []
