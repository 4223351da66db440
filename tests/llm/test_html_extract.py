import re
from html import unescape

import pytest

from corpuscope.llm.html_extract import extract, main_text
from corpuscope.llm.html_extract_queries import op12_tag_path_text


def article(html):
    """Paragraphs and headings of a page's only article, by its plain tags."""
    inner = re.sub(r"</?b>", "", html[html.index("<article>") + 9:html.index("</article>")]).replace("<br>", " ")
    blocks = [" ".join(unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_all_pages(spark, sf):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = op12_tag_path_text(spark, sf).collect()
    assert len(found) == len(html)
    for r in found:
        assert r["text"] == article(html[r["page_id"]]) and r["n_chars"] == len(r["text"])


WITHOUT_ARTICLE = """<html><body><div id="hd">Site name</div><div class="topNav"><a href=x>Home</a> | <a href=y>About</a></div>
<div class=col-2><div class='txt'><h2>A title here</h2><p>First paragraph, with text; and more of it.
<p>Second one: it has &nbsp; a <a href=z>link</a>, too.</p><ul><li>one<li>two</ul>tail</div></div>
<div class=comment-list><p>I do not agree, said a reader, and so on and so on.</p></div>
<form action=a>Search <input name=q></form><div id=cookie-notice>We use cookies.</div><div>Copyright 2020</div></body>"""


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("  \n ", ""), ("<nav>a</nav>", ""), ("<script>if (a<b) '</p>'</script>", ""), ("plain", "plain"),
    ("<p>only<p>two", "only\n\ntwo"), ("<p title=it's>z &am<b>p;</b> &copy &#x41;</p>", "z &amp; © A"),
    ("<a href='/x'>Home</a> <a href='/y'>About</a>", ""),
    (WITHOUT_ARTICLE, "A title here\n\nFirst paragraph, with text; and more of it.\n\nSecond one: it has a link, too.\n\none\n\ntwo\n\ntail"),
    ("<BODY><MAIN><HEADER><H1>Site</H1></HEADER><ARTICLE><HEADER><H1>T</H1><p>by me</HEADER><P>x &lt;b&gt;<!-- <p>no -->"
     "<ASIDE>ad</ASIDE><p>y<br>z<footer>end</footer></ARTICLE><ARTICLE class='comment'>a long, long, long reply.</ARTICLE></MAIN>", "T\n\nx <b>\n\ny z"),
    ("<form id=aspnet><nav>a</nav><article><p>in a form</article></form>", "in a form"),
])
def test_pages(html, text):
    assert main_text(html) == text


def test_long_and_broken_pages_take_linear_time():
    for part in ("<div>", "<p>x", "<", "<!--", "<a ", "<b>x", "<ul><li>", "</p>", "<title>", '<a b="'):
        main_text(part * 5000)


def test_odd_rows(spark):
    page = "<article><p>Words of it.</article>"
    rows = [(1, None, "a", 7, "x", 1), (1, page, "a", 7, "x", 1), (1, page, "a", 7, "x", 1), (None, "<p>w " * 20000, None, None, None, 2)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int, `a.b` string, `_` int")
    done = extract(pages)
    assert done.columns == ["page_id", "html", "a.b", "_", "text", "n_chars"]
    assert sorted(r["n_chars"] for r in done.collect()) == [0, 12, 12, 20000 + 2 * 19999]
    assert extract(pages.limit(0)).collect() == []
