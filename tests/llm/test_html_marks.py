"""Marks of what is no article: whole attributes, and not the names of an article's own sections."""

import pytest

from trailmark.llm.html_text import NAMES, main_text

PLAIN = {n: -1.0 for n in NAMES} | {"#tag": -1.0, "#word": 1.0, "p": -0.01}


@pytest.mark.parametrize(
    "html, text",
    [
        ('<article><div style="overflow:hidden"><p>One two three.</p></div></article>', "One two three."),
        ('<article><p>See <a href="/hidden-gems">these gems</a> and <a href=/x?id=search>that</a> now.</p></article>', "See these gems and that now."),
        ('<article><p title="a hidden valley">Down below.</p><p data-id="related" data-class=ad>Up there.</p></article>', "Down below.\nUp there."),
        ('<article><p>Seen.</p><p hidden>Not seen.</p><p HIDDEN="">Nor this.</p><p aria-hidden="true">Nor that.</p></article>', "Seen."),
    ],
)
def test_whole_attributes(html, text):
    assert main_text(html, PLAIN) == text
