"""The exact ratio against the textbook table."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litspark.functions import ratio


def _ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *row]  # row[j + 1] is the row before
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j + 1] + 1 if x == y else max(new[j], row[j + 2]))
        row = new
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abé𝄞 ", max_size=12), st.text(max_size=12)), min_size=1, max_size=8))
def test_any_alphabet(pairs):
    a, b = map(list, zip(*pairs))
    assert np.allclose(ratio.ratios(a, b), [_ratio(x, y) for x, y in pairs])


@pytest.mark.parametrize("cells", [1, 5000, ratio.CELLS])
def test_lengths_around_the_word_size(cells, monkeypatch):
    monkeypatch.setattr(ratio, "CELLS", cells)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    sizes = [0, 1, 2, 63, 64, 65, 127, 128, 129, 200, 300]
    pairs = [(word(m), word(n)) for m in sizes for n in sizes]
    pairs += [("a" * 130, "a" * 64), ("ab" * 70, "ba" * 70), ("日本" * 40, "本日" * 33), ("x" * 200, "y" * 200)]
    a, b = map(list, zip(*pairs))
    assert np.allclose(ratio.ratios(a, b), [_ratio(x, y) for x, y in pairs])


def test_column(spark):
    rows = [("Théorie", "theorie"), ("", ""), ("", "x"), (None, "x"), ("x", None), ("Markets and Power", "POWER and markets"), ("é", "É")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.r for r in df.select(ratio.exact_ratio("a", "b").alias("r")).collect()]
    want = [None if a is None or b is None else _ratio(a.lower(), b.lower()) for a, b in rows]
    assert [g is None for g in got] == [w is None for w in want]
    assert np.allclose([g for g in got if g is not None], [w for w in want if w is not None])
    assert got[1] == 1.0 and got[2] == 0.0 and got[6] == 1.0


def test_query_over_every_pair(spark):
    import __spark_entry__ as E
    from litspark.plans.q_text import title_pairs
    from litspark.sources.tables import Tables
    folder = "/root/testdata/sf0.001"
    want = {r.cite_id: round(_ratio(r.a.lower(), r.b.lower()), 6) for r in title_pairs(Tables(spark, folder)).collect()}
    got = {r.cite_id: r.ratio for r in E.queries()["str34_exact_ratio"](spark, folder).collect()}
    assert got == want and len(got) > 10
