"""Extraction against pages whose text is known."""

import pytest

from trailmark.llm.html_text import NAMES, best_region, extract, learned_weights, main_text

PLAIN = {n: -1.0 for n in NAMES} | {"#tag": -1.0, "#word": 1.0, "p": -0.01}


def test_best_region_is_the_greatest_sum():
    import random

    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        best = max(sums.values(), default=0)
        found = best_region(scores)
        assert (found is None) == (best <= 0)
        if found:
            assert sums[found] == best


@pytest.mark.parametrize(
    "html, text",
    [
        (
            '<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=1>x y z</a></nav><div class="ad">Buy now please'
            ' do it</div><div class="post"><h1>Title here</h1><p>One two <b>three</b>four five &amp; six<br>seven eight.<p>Be.<ul><li>a'
            '<li>b c</ul><div class="comments"><p>lots of comment text here and there and so on and on</p></div></div><aside>side words'
            "</aside><footer>&copy; foo</footer>",
            "Title here\nOne two threefour five & six seven eight.\nBe.\na\nb c",
        ),
        (
            '<div class="cookie-notice">We use cookies<p>ok</div><main><div id="content"><p>Alpha beta gamma delta.</p><form>search me'
            '</form><p>Last.</p></div></main><script>var a="<p>x</p>"; unclosed',
            "Alpha beta gamma delta.\nLast.",
        ),
        ("<article><p>kept &#233;&lt;b&gt;&nbsp; &middot; x <!-- not <p>this</p> --><style>p{}</style>end</article> tail", "kept é<b> · x end"),
        ('<div class="ad">open advert<article><h1>Head</h1><p>Body text of it.</article>', "Head\nBody text of it."),
        ("<article><p>cut off in the mid <a hre", "cut off in the mid"),
        ("plain words only &am", "plain words only &am"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<nav>only a menu</nav>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_known_pages(html, text):
    assert main_text(html, PLAIN) == text


def test_broken_markup_takes_linear_time():
    import time

    start = time.time()
    for html in ('<a "' * 100_000, "<div>" * 10_000 + "x", "<!--" * 50_000, "<script>" * 50_000, "<" * 200_000):
        main_text(html, PLAIN)
    assert time.time() - start < 20


def test_whole_pages_of_any_length():
    words = " ".join(f"w{i}" for i in range(200_000))
    assert main_text(f"<nav>m</nav><article><p>{words}</p></article>", PLAIN) == words


def page(i):
    paragraphs = [f"Text {i} of paragraph {k}." for k in range(1 + i % 5)]
    html = (
        f"<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>Menu {i}</a></li></ul></nav><div class='ad'>Buy {i} now</div>"
        f"<article><h1>Title {i}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article><footer>Foot {i}</footer></body></html>"
    )
    return (i, f"http://x/{i}", html), "\n".join([f"Title {i}", *paragraphs])


def test_extract_and_weights(spark):
    rows, texts = zip(*map(page, range(60)))
    pages = spark.createDataFrame(list(rows), "page_id long, url string, html string").repartition(3)
    weights = learned_weights(pages)
    assert weights["#word"] > 0 and all(v < 0 for n, v in weights.items() if n != "#word") and weights["a"] < weights["p"]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract(pages).collect()}
    assert got == {i: (f"http://x/{i}", t, len(t)) for i, t in enumerate(texts)}


def test_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract(empty).collect() == []
    rows = [(None, None, None), (1, "u", ""), (1, "u", "<p>twice"), (1, "u", "<p>twice")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as name")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract(odd).collect())
    assert got == [("1", "", 0), ("1", "twice", 5), ("1", "twice", 5), ("None", "", 0)]
