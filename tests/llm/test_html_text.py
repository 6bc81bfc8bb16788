"""Main texts of pages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanqc.llm.html_lines import ARTICLE, OTHER, PLAIN, lines_of, shared_lines
from spanqc.llm.html_text import main_texts, template_lines

SCHEMA = "page_id long, url string, html string"


def length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_by_brute_force():
    rng = random.Random(1)
    for n in range(300):
        a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randint(0, 40))] for _ in range(2))
        places = shared_lines(a, b)
        assert places == sorted(set(places)) and len(places) == length(a, b), n
        rest = iter(b)
        assert all(a[k] in rest for k in places)


def texts(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("host", "path", "page", "gone", "text", "n_chars", "hashes")})
    return {r.page_id: r.text for r in main_texts(frame.repartition(4), **more).collect()}


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{a:"<p>"}</style><script>var t="</p>";</script></head><body class="has-sidebar ad">
<header class="site">Site</header><nav><ul><li><a href="/a">A<li>B</ul></nav><div class="ad-slot">Buy<div>now</div></div><!-- <article>no</article> -->
<div class="page-with-sidebar"><article class="post comments-open"><header><h1>Title &amp; more</h1></header><p>One<b>&nbsp;two<br>three <span class="ad">x</span>four<p>fi<i>ve</i>
<aside>side</aside><div id="cookie-notice">cookies</div><form>Name <input></form><p title="a > b">&lt;six&gt; &eacute;&#233;&copy
<footer>Written by</footer></article><section id="comments"><article class="comment">I think</article></section></div><div role="complementary">more</div><footer>End</footer>"""


def test_marked_parts(spark):
    assert texts(spark, [(1, "http://h/a", PAGE), (2, None, PAGE), (3, "x", None), (4, "http://h/b", ""), (5, "http://h/b", "plain & text"), (6, "http://h/c", "<article></article><p>x")]) == {
        1: "Title & more One two three four five <six> éé©", 2: "Title & more One two three four five <six> éé©", 3: "", 4: "", 5: "plain & text", 6: "x",
    }


def test_parts_of_lines():
    assert lines_of("<div class=ad>a</div>b<p>c<div class='menu'>d<p>e</div>f") == [(OTHER, "a"), (PLAIN, "b"), (PLAIN, "c"), (OTHER, "d"), (OTHER, "e"), (PLAIN, "f")]
    assert lines_of("<article>a<script>b") == [(ARTICLE, "a")] and lines_of("<a") == [(PLAIN, "<a")] and lines_of("1 < 2 <b>x</b>y") == [(PLAIN, "1 < 2 xy")]
    assert lines_of("<div class='x><p>a</p>") == [(PLAIN, "a")]


def test_unmarked_pages_lose_what_their_neighbours_share(spark):
    """Pages of blocks without any marks: lines of the template go, those of the text stay, repeated or not."""
    def page(k, n):
        body = "".join(f"<div>text {k} {j}</div>" for j in range(n))
        return f"<div>Site</div><div>Welcome</div><table><tr><td>Home<td>Shop</table>{body}<div>text {k} 0</div><div>All rights</div>"

    rows = [(k, f"http://h{k % 3}/a/{k}", page(k, 3)) for k in range(40)] + [(100, "http://alone/x", page(100, 2)), (101, "http://h0/a/0", page(0, 3))]
    got = texts(spark, rows, keep=("url",))
    assert {k: got[k] for k in range(40)} == {k: f"text {k} 0 text {k} 1 text {k} 2 text {k} 0" for k in range(40)}
    assert got[100] == "Site Welcome Home Shop text 100 0 text 100 1 text 100 0 All rights" and got[101] == got[0]


@pytest.mark.parametrize("parts", [1, 7])
def test_ranges_change_nothing(spark, parts):
    """The nearest page is found across ranges, and a copy keeps its lines."""
    rows = [(k, f"https://H.x/{'a' if k < 9 else 'b'}/{k:02d}?q=1", f"<p>{'a' if k < 9 else 'b'} top</p><p>own {k}</p>") for k in range(18)]
    rows += [(50, "https://copy/a", "<p>one</p><p>two</p>"), (51, "https://copy/b", "<p>one</p><p>two</p>")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = texts(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {k: f"own {k}" for k in range(18)} | {50: "one two", 51: "one two"}


def test_articles_that_share_lines_stay_whole(spark):
    rows = [(k, f"http://h/{k}", f"<p>menu</p><article><p>shared</p><p>own {k}</p></article>") for k in range(4)]
    assert texts(spark, rows) == {k: f"shared own {k}" for k in range(4)}


def test_marked_pages_are_aligned_as_well(spark):
    """Every page's shared lines are found; the markup checks them afterwards, gives back the article's and drops other parts that aren't shared."""
    rows = [(k, f"http://h/{k}", f"<nav>same</nav><nav>menu {k}</nav><p>top</p><article><p>shared</p><p>own {k}</p></article>") for k in range(4)]
    rows += [(9, "http://alone/9", rows[0][2]), (10, "http://copy/1", rows[0][2]), (11, "http://copy/2", rows[0][2])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(r.gone for r in template_lines(frame).collect()) == [[0, 1, 2]] * 2 + [[0, 2, 3]] * 4
    got = {r.page_id: (r.text, r.n_shared, r.n_returned) for r in main_texts(frame).collect()}
    assert got == {k: (f"shared own {k}", 3, 1) for k in range(4)} | {9: ("shared own 0", 0, 0)} | {k: ("shared own 0", 3, 0) for k in (10, 11)}


def test_long_pages(spark):
    page = "<p>top</p>" + "<p>same</p>" * 20_000 + "<b><i>" * 5000 + "<a \"" * 5000
    got = texts(spark, [(1, "http://h/1", page + "<p>x1"), (2, "http://h/2", page + "<p>x2")])
    assert got[1].endswith("x1") and got[2].endswith("x2")


def test_no_rows(spark):
    assert main_texts(spark.createDataFrame([], SCHEMA)).collect() == []
