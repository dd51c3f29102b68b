"""Edit distances by bits against the textbook table."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litspark.functions import edits
from tests.test_operators import _edits


@settings(max_examples=100, deadline=None)
@given(st.text("abé𝄞 ", max_size=15), st.lists(st.text(max_size=12), max_size=8))
def test_any_alphabet(text, others):
    which, found = edits.Texts(others).distances(text, 0, 99)
    assert dict(zip(which.tolist(), found.tolist())) == {i: _edits(text, x) for i, x in enumerate(others)}


@pytest.mark.parametrize("cells", [1, 3000, edits.CELLS])
def test_lengths_around_the_word_size_and_bands(cells, monkeypatch):
    monkeypatch.setattr(edits, "CELLS", cells)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    others = [word(n) for n in (0, 1, 5, 60, 63, 64, 65, 66, 100, 128, 129, 190)] * 2
    texts = edits.Texts(others)
    for m in (0, 1, 2, 63, 64, 65, 127, 128, 129, 200):
        text = word(m)
        which, found = texts.distances(text, 5, 128)
        want = {i: _edits(text, x) for i, x in enumerate(others) if 5 <= len(x) <= 128}
        assert dict(zip(which.tolist(), found.tolist())) == want
    which, found = texts.distances("abc", 300, 400)
    assert len(which) == len(found) == 0
