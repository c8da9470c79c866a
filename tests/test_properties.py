"""Properties of the sequential helpers."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators.history import CAP, History
from lodestone.operators.syntax import kinds


@given(st.text(alphabet="ab1 \t\n/*#\"'\\<>.eE+-é", max_size=80))
@settings(max_examples=300, deadline=None)
def test_runs_cover_the_text(text):
    data = text.encode()
    runs = kinds(data)
    assert [a for a, _, _ in runs] == ([0, *[b for _, b, _ in runs[:-1]]] if runs else [])
    assert (runs[-1][1] if runs else 0) == len(data)
    assert all(x[2] != y[2] for x, y in zip(runs, runs[1:], strict=False))


@given(st.lists(st.tuples(st.sampled_from(["jump", "back", "forward"]), st.integers(0, 5)), max_size=300))
@settings(max_examples=100, deadline=None)
def test_history_stays_in_bounds(steps):
    h = History()
    for action, place in steps:
        at = h.apply(action, str(place), None)
        assert -1 <= h.cursor < len(h.entries) <= 2 * CAP + 1
        assert (h.cursor == -1) == (not h.entries)
        if action == "jump":
            assert h.entries[h.cursor] == at == str(place)
