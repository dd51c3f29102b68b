import math
import re
from collections import Counter

import numpy as np
import pytest

from litspark.llm import lexical_search
from litspark.llm.words import ALPHANUMERIC, split_words
from tests.llm.conftest import texts


def _terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def _ranked(docs, items, k=10):
    """Every document against every item, by the definition."""
    tf = [(i, Counter(_terms(t))) for i, t in docs]
    many, terms = sum(bool(c) for _, c in tf), sum(c.total() for _, c in tf)
    df = Counter(w for _, c in tf for w in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in tf:
            m = 100 - 90 + (90 * c.total() * many) // max(terms, 1)
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m))
                        for w in set(_terms(text)) if c[w])
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def _rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def _items(benchmark):
    return [(r.item_id, r.text) for r in benchmark.collect()]


@pytest.mark.parametrize("coordinates", [1, 8, 1024])
def test_equals_brute_force_with_any_sketch(edge, benchmark, coordinates, monkeypatch):
    want = _ranked(texts(), _items(benchmark), 3)
    assert _rows(lexical_search.search(edge, benchmark, 3, coordinates)) == want
    assert any(r[2] is None for r in want)


def test_items_in_several_blocks_and_repeated(edge, benchmark, monkeypatch):
    twice = benchmark.unionByName(benchmark.filter("item_id = 2"))
    want = _ranked(texts(), _items(twice))
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 2)
    assert _rows(lexical_search.search(edge, twice)) == want
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 3)
    assert _rows(lexical_search.search(edge, twice)) == want


def test_empty_tables(edge, none, benchmark):
    assert lexical_search.search(none, benchmark).count() == 0
    assert lexical_search.search(edge, benchmark.limit(0)).count() == 0
    assert lexical_search.search(edge.filter("doc_id < 4"), benchmark).count() == 0
    assert lexical_search.search(edge, benchmark).columns == ["item_id", "rank", "doc_id", "score"]


def test_many_tied_documents(spark, benchmark):
    rows = [(i, "one two and more" if i % 3 else f"word{i} two") for i in range(400, 0, -1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert _rows(lexical_search.search(docs, benchmark)) == _ranked(rows, _items(benchmark))


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    rank = np.minimum(rng.zipf(1.3, (400, 80)) - 1, 2999)
    docs = [" ".join(vocabulary[i] for i in row) for row in rank]
    items = [" ".join(vocabulary[i] for i in np.minimum(rng.zipf(1.3, 20) - 1, 2999)) for _ in range(20)]

    def words(of):
        data = np.frombuffer("".join(of).encode(), np.uint8)
        return split_words(data, np.concatenate([[0], np.cumsum([len(x.encode()) for x in of])]), ALPHANUMERIC)

    asked = words(items)
    h1, h2 = asked.hashes(), lexical_search._second(asked, np.arange(len(asked.start)))
    block = lexical_search.Block.of([(q, q, *np.unique(np.stack([h1[a:b], h2[a:b]], 1), axis=0).view(np.int64).T)
                                     for q, (a, b) in enumerate(zip(asked.first[:-1], asked.first[1:]))])
    held = Counter(w for d in docs for w in set(d.split()))
    block.weight = np.array([math.floor(1000 * math.log(802 / (2 * n + 1))) for n in
                             _held(block, words(list(held)), list(held.values()))], np.int64)
    scorer = lexical_search.Scorer(block, 400, 32000, 1024)
    bound = scorer.load(words(docs))
    d, q = np.divmod(np.arange(bound.size), len(items))
    exact = scorer.exact(d, q).reshape(bound.shape)
    assert (bound >= exact).all()
    best, compared = lexical_search.Best(len(items), 10), 0
    for a in range(0, 400, 50):
        compared += lexical_search.rescored(scorer, best, words(docs[a:a + 50]), np.arange(a, a + 50), np.zeros(50, bool))
    assert (best.score == -np.sort(-exact, axis=0)[:10].T).all()
    assert compared < 0.5 * bound.size


def _held(block, words, n):
    out = np.zeros(len(block.h1), int)
    for h, many in zip(words.hashes(), n):
        out[block.h1 == h] = many
    return out
