"""Sections and wrappers whose names hold a word that marks other elements."""

import pytest

from trailmark.llm.html_text import NAMES, main_text

PLAIN = {n: -1.0 for n in NAMES} | {"#tag": -1.0, "#word": 1.0, "p": -0.01}
TEXT = "Alpha beta gamma delta epsilon zeta eta theta iota kappa."


@pytest.mark.parametrize(
    "html, text",
    [
        (f'<article><h2 id="social-history">Social history</h2><p>{TEXT}</p></article>', f"Social history\n{TEXT}"),
        (f'<article><p>{TEXT}</p><section id="search"><h3 id="related-work">Work</h3><p>More.</p></section></article>', f"{TEXT}\nWork\nMore."),
        (f'<main><p>{TEXT}</p><p class="notice-period">A month.</p></main>', f"{TEXT}\nA month."),
        (f'<div class="page-with-sidebar"><p>{TEXT}</p><div class="sidebar">side words</div></div>', TEXT),
        (f'<div id="post-and-comments"><p>{TEXT}</p><div class="comments"><p>nice one</p></div></div>', TEXT),
        (f'<article><p>{TEXT}</p><div class="related-posts">Read on</div><div id="comments">nice</div><ul class="share">x</ul></article>', TEXT),
    ],
)
def test_named_sections(html, text):
    assert main_text(html, PLAIN) == text
