"""Wrapping forms, sections with partly marked names, comments that are articles, and stray tags in linear time."""

import random
import time

import pytest

from trailmark.llm.html_text import NAMES, best_region, content_of, main_text, parsed, settle

PLAIN = {n: -1.0 for n in NAMES} | {"#tag": -1.0, "#word": 1.0, "p": -0.01}
TEXT = "Alpha beta gamma delta epsilon zeta eta theta iota kappa."
COMMENT = '<article><p>I liked this a lot and wrote more than the author did, really.</p></article>'


@pytest.mark.parametrize(
    "html, text",
    [
        (f'<body><form method="post"><div><p>{TEXT}</p><input value="x"><button>Go on</button></div></form></body>', TEXT),
        (f"<article><p>{TEXT}</p><form>search me</form><label>name</label></article>", TEXT),
        (f'<div><p>{TEXT}</p><div class="social-history"><h2>Old days</h2><p>{TEXT}</p></div></div>', f"{TEXT}\nOld days\n{TEXT}"),
        (f'<div><p>{TEXT}</p><div class="part reply-x"><p>{TEXT}</p></div><p>End.</p></div>', f"{TEXT}\n{TEXT}\nEnd."),
        (f'<div><p>{TEXT}</p><p>{TEXT}</p><div class="my-related-x"><a>one</a> <a>two</a></div></div>', f"{TEXT}\n{TEXT}"),
    ],
)
def test_wrappers_and_sections(html, text):
    assert main_text(html, PLAIN) == text


@pytest.mark.parametrize("holder", ['<section id="comments">{}{}</section>', '<ol class="comment-list"><li>{}<li>{}</ol>', '<div id="disqus_thread">{}{}</div>'])
@pytest.mark.parametrize("layout", ["<article><p>{t}</p>{c}</article>", "<main><article><p>{t}</p></article>{c}</main>", "<body><article><p>{t}</p></article>{c}</body>"])
def test_comments_as_articles(holder, layout):
    assert main_text(layout.format(t=TEXT, c=holder.format(COMMENT, COMMENT)), PLAIN) == TEXT


def test_marked_articles():
    html = f'<main><article><p>{TEXT}</p></article><article class="comment">{"so nice " * 20}</article></main>'
    assert main_text(html, PLAIN) == TEXT


def test_stray_tags_take_linear_time():
    start = time.time()
    for html in ("<i>" * 100_000 + "</u>" * 100_000, "<i>" * 100_000 + "<p></p>" * 30_000, "<i>" * 50_000 + "<article></article>" * 20_000, "<b><div>" * 50_000 + "</p>" * 100_000):
        main_text(html, PLAIN)
    assert time.time() - start < 30


def test_regions_of_whole_pages():
    draw = random.Random(1)
    for _ in range(150):
        html = "".join(draw.choice(["<p>", "</p>", "<div>", "</div>", "<a>", "</a>", "one two ", "x ", '<div class="ad">', "<li>"]) for _ in range(draw.randint(1, 14)))
        page = settle(parsed(html), PLAIN)
        scores = [(0.0 if d else n * 1.0) if not t else PLAIN.get(t, -1.0) for t, n, d in zip(page.tag, page.words, page.dropped)]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        best = max(sums.values(), default=0)
        region, found = best_region(scores), content_of(page, PLAIN)
        assert (region is None) == (found is None) == (best <= 1e-9)
        if region:
            assert abs(sums[region] - best) < 1e-9
            words = [i for i in range(*region) if page.words[i] and not page.dropped[i]]
            assert found[0] <= words[0] and found[1] > words[-1]
