"""Heads without an end tag, and elements that close themselves."""

import pytest

from quarry.llm import html_text


@pytest.mark.parametrize("page, want", [
    ("<head><title>t</title><body><article><p>kept words</p></article>", "kept words"), ("<head><script>'<p>x</p>'</script><meta a=b><p>kept words</p>", "kept words"),
    ("<head><title>t</title></head><p>kept words</p>", "kept words"), ('<svg class="i"/><p>kept words</p>', "kept words"), ("<svg><p>x</p></svg><p>kept words</p>", "kept words"),
])
def test_text_after_open_heads_and_closed_elements(page, want):
    assert html_text.model().text(page) == want
