"""Pages of unusual make."""

from __future__ import annotations

import pytest

from lodestone.llm import htmltext

LONG = "The committee met on Tuesday and agreed, after some hours of talk, that the bridge should be built of stone, not of wood."
OTHER = "Costs were put at two million; work is to begin in spring, when the river is low, and to end before the first frost."
PAGES = [
    (f"{LONG} {OTHER}", f"{LONG} {OTHER}"),
    (f"<ul><li>{LONG}<li>{OTHER}</ul>", f"{LONG}\n{OTHER}"),
    (f"<article><h1>Head</h1><p>{LONG}<svg><path d='m'><p>{OTHER}</p></article>", f"Head\n{LONG}\n{OTHER}"),
    (f"<article><p>{LONG}</p><svg><g><title>t</title><path/></g></svg><p>{OTHER}</p></article>", f"{LONG}\n{OTHER}"),
    (f"<article><p>{LONG}</p><svg><foreignObject><p>no</p></foreignObject></svg><p>{OTHER}</p></article>", f"{LONG}\n{OTHER}"),
    ('<nav><a href="/">Home</a> <a href="/a">About us</a></nav><footer>All rights reserved</footer>', ""),
    ('<div class="cookie-notice"><p>We use cookies.</p></div><form><p>Search here</p></form>', ""),
    ('<div><a href="/">Home</a> | <a href="/b">Blog and news</a></div>', ""),
    ("", ""), (None, ""), ("<svg>", ""), (" \n\t ", ""),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_pages(html, text):
    assert htmltext.main_texts([html], htmltext.model()) == [text]
