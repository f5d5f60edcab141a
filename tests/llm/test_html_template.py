"""Constant texts of hosts without article, main or a content name."""

import pytest

from quarry.llm import html_wrappers

NUMBERS = "one two three four five six seven eight nine ten eleven twelve".split()


def host(n):
    """n pages of one template: each with its own paragraphs, some with elements no other page has."""
    pages, texts = [], []
    for i in range(n):
        own = [f"first paragraph of page {NUMBERS[i]}, which is its own", f"second paragraph of page {NUMBERS[i]}"]
        body = f"<p>{own[0]}</p><ul><li>point {NUMBERS[i]}</li></ul><p>{own[1]}</p>"
        want = [own[0], f"point {NUMBERS[i]}", own[1]]
        if i == 0:
            body, want = body + "<blockquote>a quote</blockquote>", [*want, "a quote"]
        if i == 1:
            body, want = body + "<div><p>a <b>lone</b> word</p></div>", [*want, "a lone word"]
        if i in (1, 2):
            body, want = "<h2>Summary</h2>" + body, ["Summary", *want]
        pages.append(f"<html><body><div>Our Site<div>All rights reserved</div>{body}</div></body></html>")
        texts.append("\n".join(want))
    return pages, texts


@pytest.mark.parametrize("n", [4, 12])
def test_only_texts_of_nearly_all_pages_are_template(spark, n):
    pages, texts = host(n)
    rows = [(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)] + [(100 + i, f"http://a.example/e{i}", v) for i, v in enumerate((None, "", " "))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3, "page_id")
    for limit in (1 << 26, 0):
        got = {r.page_id: r.text for r in html_wrappers.extract(df, broadcast_bytes=limit).collect()}
        assert got == dict(enumerate(texts)) | {100: "", 101: "", 102: ""}


def test_a_page_without_the_template_leaves_it_template(spark):
    pages, texts = host(12)
    pages.append("<p>not found</p>")
    assert [texts_of(spark, pages)[i] for i in range(12)] == texts


def test_a_text_repeated_on_one_page_counts_once(spark):
    pages = ["<div><p>x</p><hr><p>x</p><hr><p>x</p><hr></div>"] + [f"<div><p>own {n}</p></div>" for n in NUMBERS[:4]]
    assert texts_of(spark, pages)[0] == "x\nx\nx"


def texts_of(spark, pages, parts=3, url="http://a.example/{}"):
    rows = [(i, url.format(i), p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts, "page_id")
    return {r.page_id: r.text for r in html_wrappers.extract(df).collect()}


def alone(page):
    return html_wrappers.main_text(page, html_wrappers.compiled(html_wrappers.expression(page)))


def test_nothing_equal_on_all_pages_is_taken_from_an_article(spark):
    page = "<article><h1>Title {0}</h1><h2>Ingredients</h2><p>Body {0}.</p><p>Serves four</p></article>"
    for n in (1, 2, 3, 6):
        assert texts_of(spark, [page.format(k) for k in NUMBERS[:n]]) == {i: f"Title {k}\nIngredients\nBody {k}.\nServes four" for i, k in enumerate(NUMBERS[:n])}


def test_the_other_pages_of_a_host_change_a_text(spark):
    page = "<div><p>Our site</p><ul><li>Home</li><li>News</li></ul><h1>Title {0}</h1><h2>Ingredients</h2><p>Body {0} that is long enough to stand.</p><hr>Share this on social</div>"
    pages = [page.format(n) for n in NUMBERS[:6]]
    # Alone, a page says nothing of its template; aligned with others, what stands constant around their variable part goes.
    assert alone(pages[0]) == "Our site\nHome\nNews\nTitle one\nIngredients\nBody one that is long enough to stand.\nShare this on social"
    for n in (2, 3, 6):
        assert texts_of(spark, pages[:n])[0] == "Title one\nIngredients\nBody one that is long enough to stand."
    # Copies of one page tell nothing either.
    assert set(texts_of(spark, pages[:1] * 5).values()) == {alone(pages[0])}


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p title=it's>one</p><p>two it's</p></article>", "one\ntwo it's"),
        ('<article><p>a</p><div class="related-work">b</div><p class="ad-hoc">c</p><div class="ad">d</div><div class="cookie-notice">e</div></article>', "a\nb\nc"),
        ("<header><p>Site header</p></header><div><p>text</p></div>", "text"),
        ("<article><header><h1>T</h1></header><p>b <math><mi>x</mi></math></p><noscript>n</noscript></article>", "T\nb x\nn"),
        ("<article>a<b>b</b> c<br>d <span class='share'>no<div>no</div></span>e</article>", "ab c d e"),
        ("<article><p>one<p>two<!-- open <p>three", "one\ntwo"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<div id='sidebar'>s</div><div id='x7f3a'>own</div>", "own"),
        ("<p>&lt;b&gt; &amp;amp; &#233;&nbsp;x</p>", "<b> &amp; é x"),
    ],
)
def test_what_a_page_keeps(page, text):
    assert alone(page) == text


def test_the_order_of_pages_does_not_matter(spark):
    pages = ["<div><p>a1</p></div><p>b</p>", "<div><ul><li>a2</ul><p>c</p></div>", "<p>b</p><div><p>a3</p><hr></div>", "<section><p>a4</p></section><div>d</div>"]
    expressions = [html_wrappers.expression(p) for p in pages]
    import itertools
    import json

    import pyarrow as pa

    found = set()
    for order in itertools.permutations(expressions):
        # As tasks hand them on: some shapes merged before, in any order.
        rows = [("h", 0, html_wrappers.shape(e), json.dumps(e), 1) for e in order]
        table = pa.table([pa.array([r[k] for r in rows]) for k in range(5)], ["host", "salt", "shape", "wrapper", "pages"])
        found.add(html_wrappers._merged(table).column("wrapper")[0].as_py())
    assert len(found) == 1
    assert texts_of(spark, pages, 1) == texts_of(spark, pages, 4)


def test_common_subsequences_are_longest():
    import random

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(0, 14))] for _ in range(2))
        pairs = html_wrappers.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x < y for x, y in zip(pairs, pairs[1:]))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def test_recall_on_pages_without_an_article(spark):
    """Blocks of the content found, and blocks of the template left out, by alignment alone."""
    import random

    r = random.Random(7)
    words = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    pages, want = [], []
    for i in range(40):
        body = [words(r.randrange(8, 40)) for _ in range(r.randrange(3, 9))]
        boxes = "".join(f"<p>{t}</p>" for t in body)
        pages.append(f"<html><body><div><p>Our site</p><p>All about it</p></div><div><div><p>Log in</p></div><div>{boxes}</div></div><div><p>Imprint</p><p>Terms</p></div></body></html>")
        want.append("\n".join(body))
    got = texts_of(spark, pages)
    assert sum(got[i] == want[i] for i in range(40)) >= 38


def test_clashing_columns_repeated_rows_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>paragraph {i}</p><ul><li>x{i}</ul>" for i in range(6000)) + "</article>"
    rows = [(1, "http://h/1", "<p>same</p>"), (1, "http://h/1", "<p>same</p>"), (2, "http://deep/", deep), (3, "http://long/", long), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for c in ("host", "salt", "wrapper", "template", "text", "pages"):
        df = df.selectExpr("*", f"'x' AS {c}")
    for limit in (1 << 26, 0):
        got = [(r.page_id, r.text) for r in html_wrappers.extract(df, broadcast_bytes=limit).collect()]
        assert sorted(got, key=str)[:2] == [(1, "same"), (1, "same")] and (2, "deep") in got and (None, "") in got
        assert dict(got)[3].count("\n") == 11999
