import random
from collections import defaultdict
from html.parser import HTMLParser

from pyspark.sql import functions as F

from evidence_jobs.llm import html_main

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><header class=top>Site name</header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>One <b>bo</b>ld<br>line<p>Two&nbsp;words<aside>Related</aside><div class="share">Share</div><p>Three</article>
<section id="comments"><p>Reader says</p></section><form>Search<input></form><footer>&copy; x</footer></body>"""


def test_main_text_of_a_page():
    assert html_main.main_text(PAGE) == "Title & more One bold line Two words Three"
    assert html_main.main_text("") == "" and html_main.main_text("plain <b>text") == "plain text"
    assert html_main.main_text("<p>a < b & c</p><!-- no") == "a < b & c"


def test_template_of_a_host(spark):
    page = lambda i: f"<html><body><div>Site of many things</div><div><p>story {i} alpha</p><p>more {i} beta</p></div><div>Made by us</div></body></html>"
    rows = [(i, "http://Host.example/a", page(i)) for i in range(8)] + [(50, "http://lone.example/x", page(99)), (60, None, None), (61, "http://host.example/z", page(1)), (61, "http://host.example/z", page(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = defaultdict(list)
    for r in html_main.extract_main(df).collect():
        got[r["page_id"]].append(r)
    assert got[3][0]["text"] == "story 3 alpha more 3 beta" and got[3][0]["n_chars"] == 25
    assert got[50][0]["text"] == "Site of many things story 99 alpha more 99 beta Made by us"
    assert got[60][0]["text"] == "" and len(got[61]) == 2
    assert html_main.extract_main(df.limit(0)).count() == 0


def plain_match(a, b):
    """Simple tree matching as it is defined, by recursion over all pairs."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_match(x, y))
    return best[-1][-1] + 1


def random_tree(rng, depth):
    node = html_main.Node(rng.choice(["div", "p", "ul"]) if depth < 3 else "div")
    node.children = [random_tree(rng, depth - 1) if depth and rng.random() < 0.8 else html_main.Node("#", text=rng.choice("abc")) for _ in range(rng.randrange(5))]
    return node


def test_tree_matching_is_that_of_all_pairs():
    rng = random.Random(5)
    for _ in range(150):
        a, b, shapes = random_tree(rng, 3), random_tree(rng, 3), html_main.Shapes()
        for tree in (a, b):
            shapes.number(html_main.annotated(tree))
        assert shapes.weight(a.shape, b.shape) == plain_match(a, b)
        pairs = html_main.tree_match(a, b, shapes)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
        assert all(x.path == y.path for x, y in pairs)


def test_leaves_that_match():
    a, b, shapes = html_main.parse("<div><p>x</p><ul><li>1</li></ul><p>y</p></div>"), html_main.parse("<div><p>x</p><p>y</p></div>"), html_main.Shapes()
    for tree in (a, b):
        shapes.number(html_main.annotated(tree))
    assert shapes.weight(a.shape, b.shape) == 6
    assert sorted((x.text, y.text) for x, y in html_main.tree_match(a, b, shapes)) == [("x", "x"), ("y", "y")]


class Article(HTMLParser):
    """The text inside <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.parts.append(" " if tag in html_main.BLOCK or tag == "br" else "")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.parts.append(" " if tag in html_main.BLOCK else "")

    def handle_data(self, data):
        self.parts.append(data if self.inside else "")


def test_the_query_against_another_parser(spark):
    sf = "/root/testdata/sf0.01"
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html_main.op8_html_extraction(spark, sf).collect()
    assert len(got) == len(html)
    for r in got:
        other = Article()
        other.feed(html[r["page_id"]] or "")
        other.close()
        assert r["text"] == " ".join("".join(other.parts).split()) and r["n_chars"] == len(r["text"])


def neutral(i, words):
    """A page whose tags and classes say nothing of their kinds."""
    links = "".join(f"<li><a href='/{i}{k}'>topic {i * 7 + k}</a></li>" for k in range(5))
    body = "".join(f"<p>{w}</p>" for w in words)
    return f"<html><body><div class=b1><ul>{links}</ul></div><div class=b2>Sale {i} today</div><div class=b3><h1>Story {i}</h1><div class=b4>{body}<p>All rights reserved by us</p></div></div><div class=b5>Made {i} by us</div></body></html>"


def test_the_wrapper_decides_where_kinds_say_nothing(spark):
    rng = random.Random(2)
    texts = [[" ".join(f"w{rng.randrange(999)}" for _ in range(30)) for _ in range(rng.randrange(2, 6))] for _ in range(12)]
    rows = [(i, "http://h.example/x", neutral(i, t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for hints in (True, False):
        got = {r["page_id"]: r["text"] for r in html_main.extract_main(df, hints=hints).collect()}
        assert got == {i: " ".join([f"Story {i}", *t]) for i, t in enumerate(texts)}
    assert all("Sale" in html_main.main_text(h) for _, _, h in rows)  # without the wrapper all of it stays


def test_near_copies_of_a_story_are_no_template(spark):
    rows = [(i, "http://h.example/x", f"<html><body><div>{i}<p>One long story that every page prints</p><p>and its end</p></div></body></html>") for i in range(8)]
    got = html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"].endswith("One long story that every page prints and its end") for r in got)


def test_hints_keep_main_elements_and_odd_names():
    assert html_main.main_text('<div class="content has-sidebar"><p>Real story text.</p></div>') == "Real story text."
    assert html_main.main_text('<div class="page layout-side-nav"><main><p>Real story text.</p></main></div>') == "Real story text."
    assert html_main.main_text('<article><h2 class="section-header">Head</h2><div class="search-engine-history">of search</div></article>') == "Head of search"
    assert html_main.main_text('<form><p>A page that is one form, with its text</p><input></form>') == "A page that is one form, with its text"
    assert html_main.main_text('<p>Short</p><div class="comment-list">a very long remark of some reader, longer than all else</div>') == "Short"


def test_deep_and_broken_markup_and_clashing_names(spark):
    deep = "<div>" * 3000
    rows = [(i, "http://h.example/x", f"{deep}story {i}", 1, "x") for i in range(3)] + [(9, "http://h.example/y", "<p <<b>>x</", 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host int, `a b.c` string")
    got = {r["page_id"]: r for r in html_main.extract_main(df).collect()}
    assert [got[i]["text"] for i in range(3)] == ["story 0", "story 1", "story 2"]
    assert got[1]["_host"] == 1 and got[1]["a b.c"] == "x"


def test_hostile_markup_takes_linear_time():
    import time

    half = 1 << 19
    for page in ("<a " * (half // 2), "<div>" * 20_000 + "</x>" * 200_000, "<a '" * (half // 2), "<a \"'" * (half // 2), "<a b" * (half // 4) + '"', "<p><article>" + "<div>" * 50_000 + "</p>" * 100_000, "<li>" * 100_000, "<!" * half, "<x" * half + ">"):
        began = time.time()
        html_main.parse(page)
        assert time.time() - began < 3, page[:20]
    assert [c.text for c in html_main.parse("a < b <c 'd").children] == ["a < b <c 'd"]
    assert html_main.parse("<p title='a > b'>x</p>").children[0].attributes == {"title": "a > b"}
