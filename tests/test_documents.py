"""Blocks, links, lists, tables and Markdown of pages, against a parser of another kind and stated cases."""

from html.parser import HTMLParser

import pytest

from sheafline.operators import documents as D

SF_DIR = "/root/testdata/sf0.001"
BLOCKS = set("h1 h2 h3 h4 h5 h6 p li ul ol div nav article footer body html".split())
HIDDEN = ("script", "style", "head")


class Walk(HTMLParser):
    """Blocks and links as the standard library's parser sees them."""

    def __init__(self, text):
        super().__init__()
        self.blocks, self.links, self.now, self.hidden, self.link = [], [], [], [], None
        self.feed(text)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden.append(tag)
        if tag in BLOCKS:
            self.flush()
        else:
            self.now.append(" ")
        if tag == "a" and not self.hidden:
            self.link = [dict(attrs).get("href") or "", ""]

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        if tag == "a" and self.link:
            self.links.append((self.link[0], " ".join(self.link[1].split())))
            self.link = None
        if tag in BLOCKS:
            self.flush()
        else:
            self.now.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.now.append(data)
            if self.link:
                self.link[1] += data


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF_DIR}/pages.parquet")


def test_blocks_and_links_of_the_given_pages(spark, pages):
    walked = {r["page_id"]: Walk(r["html"] or "") for r in pages.collect()}
    got = {}
    for r in D.html_blocks(pages).orderBy("page_id", "position").collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert {k: got.get(k, []) for k in walked} == {k: w.blocks for k, w in walked.items()}
    links = {}
    for r in D.html_links(pages).orderBy("page_id", "position").collect():
        links.setdefault(r["page_id"], []).append((r["target"], r["label"]))
    assert {k: links.get(k, []) for k in walked} == {k: w.links for k, w in walked.items()}


PAGE = """<body><h2 title="a > b">Head &eacute; &#233; &#x41;</h2><p>An <b>old</b> <i>tale</i> *star* <a href='/x_y?a=1&amp;b=2'>here</a> and <a href=/z>there</a> <code>f</code>
<ol start=3><li>three<ul><li><p>deep</p><p>more</p></ul><li>four</ol><p>after<table><tr><th>k</th><th>v|w</th></tr><tr><td colspan=2>both</td></tr></table><ul><li>last</ul>"""


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")


def test_links(page):
    assert [(r["target"], r["label"]) for r in D.html_links(page).orderBy("position").collect()] == [("/x_y?a=1&b=2", "here"), ("/z", "there")]


def test_lists(page):
    got = sorted(tuple(r)[1:] for r in D.html_lists(page).collect())
    assert got == sorted([(1, 1, 1, True, 3, "three"), (1, 1, 2, True, 4, "four"), (2, 1, 1, False, None, "deep more"), (1, 2, 1, False, None, "last")])


def test_tables(page):
    got = sorted(tuple(r)[1:] for r in D.html_tables(page).drop("last_row", "in_head").collect())
    assert got == [(1, 1, 1, 1, True, 1, 1, "k"), (1, 1, 1, 2, True, 1, 1, "v|w"), (1, 1, 2, 1, False, 1, 2, "both")]


def test_markdown(page):
    got = {r["page_id"]: r["markdown"] for r in D.html_markdown(page).collect()}
    assert got == {1: "\n\n".join([
        "## Head é é A", r"An **old** *tale* \*star\* [here](/x_y?a=1&b=2) and [there](/z) `f`", "3. three\n  - deep\n    more\n4. four", "after", "| k | v\\|w |\n| --- | --- |\n| both |", "- last",
    ]), 2: "", 3: ""}


def markdown(spark, html):
    return D.html_markdown(spark.createDataFrame([(1, html)], "page_id long, html string")).first()["markdown"]


def test_numbers_of_lists(spark):
    html = "<ol reversed><li>a<li value=7>b<li>c</ol><p>x<ol type=i start=3><li>d<li>e</ol><p>y<ol start=-1><li>f<li>g<li>h</ol><ol reversed start=3><li>i<li value=7>j<li>k</ol><ol type='A'><li>l</ol>"
    assert markdown(spark, html) == "3. a\n7. b\n6. c\n\nx\n\n- iii. d\n- iv. e\n\ny\n\n- -1. f\n- 0\\. g\n1. h\n3. i\n7. j\n6. k\n- A. l"
    got = D.html_lists(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("list_no", "item_no").collect()
    assert [r["number"] for r in got] == [3, 7, 6, 3, 4, -1, 0, 1, 3, 7, 6, 1]


def test_code_blocks_keep_their_lines(spark):
    html = "<p>a<pre><code>x  =  1\n  if &lt;b&gt; *y*:\n    ```\n</code></pre><p>z<ul><li>q<pre>k\n l</pre></ul><pre>  \n </pre>"
    assert markdown(spark, html) == "a\n\n````\nx  =  1\n  if <b> *y*:\n    ```\n````\n\nz\n\n- q\n  ```\n  k\n   l\n  ```"


def test_targets_and_picture_texts(spark):
    html = """<p><a class="a > b" href="my file.html">x_y</a> <a href='a(b)'>p</a> <a href=q|r title=z>s</a> <a href="t*u_v">w</a> <img src=a alt=plain> <img alt="two words" src=b>"""
    assert markdown(spark, html) == "[x\\_y](<my file.html>) [p](<a(b)>) [s](q%7Cr) [w](t*u_v) plain two words"


def test_table_rows_keep_empty_cells(spark):
    html = "<table><tr><td>a<td><td>c|d</tr><tr><td></td><td><p>e<p>f</td></tr></table><table><tr><th>g</table><p>h<table><tr><td>i</tr><tr></tr><tr><td>j</table>"
    assert markdown(spark, html) == "| a |  | c\\|d |\n| --- | --- | --- |\n|  | e f |\n\n| g |\n| --- |\n\nh\n\n| i |\n| --- |\n| j |"
