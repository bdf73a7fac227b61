import html as h
import re
import time

import pytest

from spindrift.llm import htmltext


def page(body, title="T & t"):
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body>"
        "<div class='cookie-notice'>We use cookies</div><header><h2>Site</h2></header><nav><ul><li><a href='/'>Home</a><li>Shop</ul></nav>"
        f"<div id=\"wrap\"><article>{body}<aside>related</aside><form><input>mail<button>go</button></form></article>"
        "<div class='sidebar'><p>side</p></div><section id=comments><p>first!</p></section></div><!-- <p>hidden --><footer>&copy; x</footer></body></html>"
    )


@pytest.mark.parametrize("body,want", [
    ("<h1>A &amp; B</h1><p>one\n two<br>three</p>", "A & B\n\none two three"),
    ("<p><b>open<br><p>next</p>tail", "open\n\nnext\n\ntail"),
    ("<p>1 < 2 &lt; 3 &eacute;&#233; &am</p>", "1 < 2 < 3 éé &am"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
    ("<p>x<script>y</script>z<style>q</style></p>", "xz"),
    ("<header><h1>own head</h1></header><p>t</p>", "own head\n\nt"),
    ("", ""),
])
def test_single_page(body, want):
    parsed = htmltext.parse(page(body))
    assert htmltext.main_text(parsed, ()) == want


@pytest.mark.parametrize("source", [None, "", "<", "<!--", "<script>x", "</p>", "<p", "text only", "<a b='", "<" * 3000, "<div>" * 3000, '<a "' * 500, "İ<script>a</script>b"])
def test_broken_pages_do_not_crash(source):
    got = htmltext.main_text(htmltext.parse(source), ())
    assert {None: "", "text only": "text only", "İ<script>a</script>b": "İb", "<script>x": ""}.get(source, got) == got


def test_main_slot_of_a_template(spark):
    """The container with the text is found by what varies, without a telling name."""
    make = lambda i: f"<html><body><div class=top>Shop {i}</div><div class=x><div class=y><h1>Head {i}</h1><p>{'word%d ' % i * (20 + i)}</p></div></div><div class=low>Imprint</div></body></html>"
    rows = [(i, f"http://a.b/{i}", make(i), "z") for i in range(30)] + [(98, "http://lone.c/", make(98), "z"), (99, None, None, "z"), (None, "x", "", "z"), (7, "http://a.b/7", make(7), "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for limit in (20_000, 0):
        got = htmltext.extract(df, limit).collect()
        assert len(got) == len(rows)
        for r in got:
            want = "" if r.page_id in (None, 99) else f"Head {r.page_id}\n\n{' '.join(['word%d' % r.page_id] * (20 + r.page_id))}"
            assert r.text == want
    assert htmltext.extract(df.limit(0)).count() == 0


def test_repeated_blocks_are_template(spark):
    make = lambda i: f"<body><article><h1>H{i}</h1><p>Share this story</p><p>{'w%d ' % i * 30}</p></article></body>"
    df = spark.createDataFrame([(i, f"http://a.b/{i}", make(i)) for i in range(25)], "page_id long, url string, html string")
    assert all("Share" not in r.text and r.text.startswith("H") for r in htmltext.extract(df).collect())
    same = spark.createDataFrame([(i, f"http://a.b/{i}", make(1)) for i in range(25)], "page_id long, url string, html string")
    assert all(r.text.startswith("H1\n\nShare this story\n\nw1") for r in htmltext.extract(same).collect())


def test_article_keeps_all_its_parts(spark):
    """What stands beside the largest container of an article is kept; what surrounds the article goes without its names."""
    make = lambda i: f"<body><div class=q><a href=/>Start</a></div><article><h1>Title {i}</h1><p>Lead {i}</p><div class=body><p>{'long%d text ' % i * 90}</p></div><p>Closing {i}</p></article><div class=z>Imprint</div></body>"
    plain = lambda i: make(i).replace("article>", "section>")
    for of in (make, plain):
        df = spark.createDataFrame([(i, f"http://a.b/{i}", of(i)) for i in range(6)], "page_id long, url string, html string")
        for r in htmltext.extract(df, names=False).collect():
            i = r.page_id
            assert r.text == f"Title {i}\n\nLead {i}\n\n{('long%d text ' % i * 90).strip()}\n\nClosing {i}"


def test_equal_pages_keep_classes_apart(spark):
    """Containers that stand in different pages are in different classes, though each page occurs twice."""
    df = spark.createDataFrame([("h", f"<body><div class=c{i // 2}>x</div></body>") for i in range(4)], "host string, html string")
    rows = [r for r in htmltext.tokens(df).collect() if r.kind == htmltext.CONTAINER]
    assert len(rows) == 2 and len({(r.s1, r.s2) for r in rows}) == 2 and all(r.s1 and r.s2 and r.pages == 2 for r in rows)


@pytest.mark.parametrize("unit", ['"<a " ', "<a ", "<div>", "<p>", "<b><p>x", "<li>", "</p>", "<td>", "<a '", "class=' "])
def test_long_broken_pages_take_linear_time(unit):
    began = time.process_time()
    for source in (unit * (600_000 // len(unit)), "<div>" * 50_000 + unit * 20_000, "<b>" * 50_000 + unit * 20_000, "<li><ul>" + "<div>" * 20_000 + unit * 20_000):
        parsed = htmltext.parse(source)
        htmltext.slots(parsed)
        htmltext.main_text(parsed)
    assert time.process_time() - began < 20


@pytest.mark.parametrize("names", [True, False])
def test_driver_pages(spark, names):
    """The template alone finds the articles, and so it does with the names."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in htmltext.extract(pages, names=names).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.DOTALL)[1]
        parts = [" ".join(h.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(x for x in parts if x)


def test_the_template_comes_before_names_inside_an_article(spark):
    """A sentence that every article repeats stays; named sections stay if their text varies and go if it does not; readers' comments go in any case."""
    def make(i):
        words = " ".join(f"w{i}x{k}" for k in range(40))
        return (
            f"<body><div class=menu>Home</div><article><h1>Head {i}</h1><p>This paper appears daily, in print and here.</p><p>{words}</p><section id=social><p>Society {words}</p></section>"
            f"<div class=notice>All rights reserved by the paper.</div><div class=comments><p>reader {i} says {words}</p></div></article><div class=low>Imprint</div></body>"
        )

    for n in (8, 40):
        df = spark.createDataFrame([(i, f"http://a.b/{i}", make(i)) for i in range(n)], "page_id long, url string, html string")
        for r in htmltext.extract(df).collect():
            words = " ".join(f"w{r.page_id}x{k}" for k in range(40))
            assert r.text == f"Head {r.page_id}\n\nThis paper appears daily, in print and here.\n\n{words}\n\nSociety {words}"
