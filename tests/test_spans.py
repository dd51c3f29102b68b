"""Phrases: sentences kept packed, spans counted and merged in batches."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from litspark.operators import spans, terms
from tests.test_operators import _scanned

CONNECTORS = ["of", "the"]


def _sentences(n=400):
    rng = random.Random(3)
    words = ["a", "b", "c", "d", "é", "of", "the"]
    return [None, [], ["of"], ["a"]] + [[rng.choice(words) for _ in range(rng.randrange(0, 14))] for _ in range(n)]


def _pairs(sentence, connectors):
    at = [p for p, w in enumerate(sentence) if w not in connectors]
    return [(sentence[i], sentence[j], "_".join(sentence[i:j + 1])) for i, j in zip(at, at[1:])]


@pytest.mark.parametrize("tokens", [1, 50, 1 << 20])
def test_packed_sentences_come_back(spark, monkeypatch, tokens):
    monkeypatch.setattr(spans, "SPAN_TOKENS", tokens)
    rows = [(k % 5 if k else None, k, x) for k, x in enumerate(_sentences(60))] + [(9, 1000, ["a", None, "", "a"])]
    df = spark.createDataFrame(rows, "d long, k int, toks array<string>").repartition(2)
    got = spans.unpacked(spans.packed(df), df.schema)
    assert got.schema == df.schema
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(rows, key=lambda r: r[1])


@pytest.mark.parametrize("connectors", [None, CONNECTORS])
@pytest.mark.parametrize("tokens", [1, 100, 1 << 20])
def test_phrases_are_counted_over_batches_and_parts(spark, monkeypatch, connectors, tokens):
    monkeypatch.setattr(spans, "SPAN_TOKENS", tokens)
    sents = _sentences()
    df = spark.createDataFrame([(x,) for x in sents], "toks array<string>").repartition(3)
    words = Counter(w for x in sents for w in x or [])
    pairs = Counter(p for x in sents for p in _pairs(x or [], connectors or []))
    n = len(words) + len(pairs)
    for least, threshold in ((5, 0.5), (5, -1.0)):
        brute = {(p, a, b, c): (c - least) * n / (words[a] * words[b]) for (a, b, p), c in pairs.items()}
        got = {(r.phrase, r.a, r.b, r["count"]): r.score for r in terms.learn_phrases(df, least, threshold, connectors=connectors).collect()}
        assert got == {k: s for k, s in brute.items() if s > threshold}


def test_a_span_travels_in_few_bytes(spark):
    """Distinct pairs of a batch are written as numbers within the part's piece."""
    rng = random.Random(4)
    vocabulary = [f"word{k:05d}" for k in range(3000)]
    sents = [[rng.choice(vocabulary) for _ in range(100)] for _ in range(1000)]
    some = spans.Spans(pa.array(sents), None, ranked=True)
    key, n = np.unique(some.key, return_counts=True)
    none = np.zeros(0, np.int64)
    pieces = dict(spans._count_pieces(some, none, none, none, key, n, key % 3, 3))
    assert sum(map(len, pieces.values())) < 5 * len(key)
    back = Counter()
    for piece in pieces.values():
        words, _, _, (a, _, b, total) = spans._sums([piece, piece])  # two pieces of a part are added
        words = words.to_pylist()
        back += Counter({(words[x], words[y]): c // 2 for x, y, c in zip(a, b, total)})
    assert back == Counter((a, b) for x in sents for a, b in zip(x, x[1:]))


def test_merging_shuffles_no_sentence(spark, monkeypatch):
    """Accepted phrases come to the sentences; sentences of one key are merged
    each on its own."""
    df = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (1, ["b", "a", "c"]), (None, ["a", "of", "b"])], "k int, toks array<string>")
    phrases = spark.createDataFrame([("a_b",), ("a_of_b",), (None,)], "phrase string")
    out = terms.apply_phrases(df, phrases, ["k"], connectors=CONNECTORS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    want = [(1, ["a_b", "a_b"]), (1, ["b", "a", "c"]), (None, ["a_of_b"])]
    assert sorted(((r.k, r.phrased) for r in out.collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(terms, "BROADCAST_PHRASES", 1)
    for tokens in (1, 1 << 20):
        monkeypatch.setattr(spans, "SPAN_TOKENS", tokens)
        got = terms.apply_phrases(df, phrases, ["k"], connectors=CONNECTORS).collect()
        assert sorted(((r.k, r.phrased) for r in got), key=str) == sorted(want, key=str)


def test_many_phrases_meet_the_spans_in_parts(spark, monkeypatch):
    sents = _sentences()
    df = spark.createDataFrame(list(enumerate(sents)), "k int, toks array<string>").repartition(3)
    accepted = ["a_of_b", "a_b", "b_the_of_c", "c_c", "é_a", "d_the_d"]
    phrases = spark.createDataFrame([(p,) for p in accepted], "phrase string")
    monkeypatch.setattr(terms, "BROADCAST_PHRASES", 2)
    monkeypatch.setattr(spans, "SPAN_TOKENS", 300)
    got = {r.k: r.phrased for r in terms.apply_phrases(df, phrases, ["k"], connectors=CONNECTORS).collect()}
    assert got == {k: x if x is None else _scanned(x, accepted, CONNECTORS) for k, x in enumerate(sents)}


def test_packed_sentences_of_documents_are_cleaned_once(spark):
    from litspark.plans.q_terms import clean_sents
    from litspark.sources.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    key = lambda r: (r[0], r[1])
    plain = sorted(map(tuple, clean_sents(t, False).collect()), key=key)
    assert sorted(map(tuple, clean_sents(t, False, packed=True).collect()), key=key) == plain
