"""The dictionary matcher against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from litspark.operators import dictionary as dc

TEXTS = ["a bc a b c", "", None, "  the cat  sat on the cat mat\nde la de late", "cat", "ca", "aaa aa a", "𝄞é catalogue é𝄞 x",
         "one two three two one two three four", "wide la\nb c a", "the cat the cat the cat"]
TERMS = ["cat", "de la", "a", "aa", "𝄞", "é𝄞 x", "two three", "one two three", "the cat", "cat the", "mat\nde", "sat on the cat", "", None,
         "zebra crossing", "b c", "a b c", "e la", "at m", "cat"]


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)


def _terms(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


def _join(sentence, terms):
    """One term after the other, as a loop of replacements."""
    several = {" ".join(t.split()) for t in terms if t and len(t.split()) > 1}
    for t in sorted(several, key=lambda t: (-len(t.split()), -len(t), t)):
        sentence = sentence.replace(t, t.replace(" ", "_"))
    return sentence.split()


@pytest.mark.parametrize("block", [100_000, 3])
def test_substrings(spark, block, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_TERMS", block)
    got = {r.id: r.hit for r in dc.with_hits(_frame(spark, TEXTS), "id", "text", _terms(spark, TERMS)).collect()}
    assert got == {i: any(t and any(t in line for line in (x or "").split("\n")) for t in TERMS) for i, x in enumerate(TEXTS)}
    none = dc.with_hits(_frame(spark, TEXTS), "id", "text", _terms(spark, TERMS).limit(0)).collect()
    assert len(none) == len(TEXTS) and not any(r.hit for r in none)


def test_every_match_with_its_place(spark):
    index = dc.TermIndex(_terms(spark, set(TERMS) - {None}), "term", by_words=False)
    df = _frame(spark, [x for x in TEXTS if x]).select("id", dc.characters("text").alias("c"))
    got = {(r.id, r.term, r.start) for r in dc.occurrences(df, "c", index).collect()}
    want = {(i, t, p + 1) for i, x in enumerate(x for x in TEXTS if x) for t in TERMS if t for p in range(len(x)) if x.startswith(t, p)}
    assert got == want


def test_word_hits(spark):
    sents = _frame(spark, TEXTS).select("id", dc.words(F.coalesce("text", F.lit(""))).alias("toks"))
    terms = spark.createDataFrame([("x", t) for t in TERMS] + [("y", "two three"), ("y", " two  three ")], "kind string, term string")
    got = {(r.id, r.kind): r.n_hits for r in dc.hit_counts(sents, ["id"], "toks", terms).collect()}
    want = Counter()
    for i, x in enumerate(TEXTS):
        toks = (x or "").split()
        for kind, t in [("x", t) for t in TERMS] + [("y", "two three")] * 2:
            w = (t or "").split()
            n = sum(toks[p:p + len(w)] == w for p in range(len(toks))) if w else 0
            if n:
                want[(i, kind)] += n
    assert got == want


def test_joined_terms_equal_the_loop(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "ab", "ba", "c"]) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    terms = [" ".join(rng.choice(["a", "b", "ab", "ba", "c"]) for _ in range(rng.randrange(1, 5))) for _ in range(40)] + ["a  b"]
    df = _frame(spark, texts).select("id", F.split("text", " ").alias("toks"))
    got = {r.id: r.fixed for r in dc.join_terms(df, ["id"], "toks", _terms(spark, terms)).collect()}
    assert got == {i: _join(x, terms) for i, x in enumerate(texts)}
    assert any("_" in w for ws in got.values() for w in ws)


def test_fifty_thousand_terms(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    terms = list({" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(51000)})[:50000]
    texts = [" ".join(rng.choice([word(), rng.choice(terms)]) for _ in range(30)) for _ in range(40)] + [word()[:3] for _ in range(40)]
    few, many = (dc.with_hits(_frame(spark, texts), "id", "text", _terms(spark, t)) for t in (terms[:500], terms))
    got = {r.id: r.hit for r in many.collect()}
    assert got == {i: any(t in x for t in terms) for i, x in enumerate(texts)}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan(many)) < 1.1 * len(plan(few))  # the plan doesn't grow with the dictionary
    sents = _frame(spark, texts).select("id", F.split("text", " ").alias("toks"))
    fixed = {r.id: r.fixed for r in dc.join_terms(sents, ["id"], "toks", _terms(spark, terms)).collect()}
    assert fixed == {i: _join(x, terms) for i, x in enumerate(texts)}
    hits = {r.id: r.n_hits for r in dc.hit_counts(sents, ["id"], "toks", _terms(spark, terms)).collect()}
    own = {tuple(t.split()) for t in terms}
    count = lambda w: sum(tuple(w[p:p + n]) in own for n in (1, 2, 3) for p in range(len(w) - n + 1))
    assert hits == {i: c for i, x in enumerate(texts) if (c := count(x.split()))}
