import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.llm import html_extract, quality, toxicity
from litspark.llm.features import bucket
from litspark.llm.html_blocks import blocks_of
from litspark.llm.words import mix, span_hashes
from tests.conftest import SF_SMALL
from tests.llm.conftest import EDGE


def _accuracy(out, labels, column):
    x = out.toPandas().merge(labels.toPandas(), on="doc_id")
    return (x.predicted == x[column]).mean(), x[x.held_out]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_quality_holds_out_of_sample(spark, labels):
    share, held = _accuracy(quality.query(spark, "/root/testdata/sf0.01"), labels, "quality")
    assert share > 0.97 and (held.predicted == held.quality).mean() > 0.95


def test_toxicity_fits(spark, labels):
    share, held = _accuracy(toxicity.query(spark, "/root/testdata/sf0.01"), labels, "toxic")
    assert share > 0.95 and (held.predicted == held.toxic).mean() > 0.88


@pytest.mark.parametrize("op", [quality, toxicity])
def test_scores_of_edge_rows(spark, edge, none, labels, op):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = op.fit(docs, labels)
    got = op.score(edge, model).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1
    assert op.score(none, model).count() == 0


@pytest.mark.parametrize("op,column", [(quality, "quality"), (toxicity, "toxic")])
def test_without_both_classes_the_share_is_the_score(spark, edge, labels, op, column):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    one = op.fit(docs, labels.withColumn(column, F.lit(1)))
    assert all(r.score > 0.99 for r in op.score(edge, one).collect())
    nothing = op.fit(docs, labels.withColumn(column, F.lit(None).cast("int")))
    assert {round(r.score, 6) for r in op.score(edge, nothing).collect()} == {0.5}


@pytest.mark.parametrize("op,column", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_do_not_depend_on_the_files(spark, edge, labels, op, column):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scores = lambda d, l: {r.doc_id: r.score for r in op.score(docs, op.fit(d, l)).collect()}
    one, other = scores(docs, labels), scores(docs.repartition(7), labels.repartition(5))
    assert max(abs(one[i] - other[i]) for i in one) < 1e-12


def test_training_rows_stay_bounded(spark, labels):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    hot = labels.filter("crc32(cast(doc_id as string)) % 3 != 1").first().doc_id
    text = F.when(F.col("id") % 2 == 0, F.lit("b")).otherwise(F.concat(F.lit("a "), F.col("id").cast("string")))
    many = docs.select("doc_id", "text").filter(F.col("doc_id") != hot).unionByName(spark.range(5000).select(F.lit(hot).alias("doc_id"), text.alias("text")))
    both = labels.unionByName(labels.filter(F.col("doc_id") == hot).select("doc_id", (1 - F.col("quality")).alias("quality"), "toxic"))
    rows = quality.training_rows(many, both, "quality", 3, 1, False, 40)
    assert rows.count() <= 40
    all_ = quality.training_rows(many, both, "quality", 3, 1, False, 10 ** 6).collect()
    assert len(all_) == len({r.key for r in all_}) and sum(r.text == "a 1" for r in all_) == 2  # both labels, the least text


def _grams(word):
    """Every byte n-gram of a word between two marks, and where it stands."""
    for n in quality.NGRAMS:
        count = len(word) + 2 - n + 1
        for at in range(max(count, 0)):
            first, last = max(at - 1, 0), min(at - 1 + n, len(word))
            yield word[first:last], 7 + 4 * n + (at == 0) + 2 * (at == count - 1)


def _hash(part):
    data = np.concatenate([np.frombuffer(part, np.uint8), np.zeros(8, np.uint8)])
    return span_hashes(data, np.array([0]), np.array([len(part)]))


def test_quality_scores_equal_a_loop_over_features(spark, edge, labels):
    model = quality.fit(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), labels)
    salt = lambda s: np.array([s], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in quality.score(edge, model).collect():
        for text in {t or "" for i, t in EDGE if i == r.doc_id}:
            words = re.findall(rb"[^\x20\x09-\x0D]+", text[:3000].encode())
            if len(text) > 3000:
                continue
            feats = []
            for k, w in enumerate(words):
                feats += [int(bucket(mix(_hash(p) + salt(s)), quality.BUCKETS)[0]) for p, s in [(w, 0), *_grams(w)]]
                feats += [quality.BUCKETS] * (k > 0 and words[k - 1] == w) + [quality.BUCKETS + 1] * (k > 1 and words[k - 2] == w)
            z = (sum(model.feature[f] for f in feats) / max(len(feats), 1)) + model.always + model.bias
            assert r.score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


def test_toxicity_scores_equal_a_loop_over_features(spark, edge, labels):
    model = toxicity.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    for r in toxicity.score(edge, model).collect():
        for text in {t or "" for i, t in EDGE if i == r.doc_id}:
            if len(text) > 3000:
                continue
            lower = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
            feats = set()
            for w in re.findall(rb"[0-9a-z\x80-\xff]+", lower):
                feats.add(int(bucket(_hash(w), toxicity.BUCKETS)[0]))
                feats |= {int(bucket(mix(_hash(w[:n]) + np.uint64(n)), toxicity.BUCKETS)[0]) for n in toxicity.BEGINNINGS if len(w) > n}
            z = sum(model.weight[f] for f in feats) + model.bias
            assert r.score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


def test_neutral_mentions_stay_low(spark, labels):
    """Held-out neutral texts keep their label when a group is named in them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").join(labels.filter("toxic = 0"), "doc_id")
    clean = docs.filter("crc32(cast(doc_id as string)) % 5 = 0").select("doc_id", "text")
    model = toxicity.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    before = {r.doc_id: r.score for r in toxicity.score(clean, model).collect()}
    for kind, terms in toxicity.GROUP_TERMS.items():
        named = clean.withColumn("text", F.concat("text", F.lit(" " + terms.split()[0])))
        after = {r.doc_id: r.score for r in toxicity.score(named, model).collect()}
        assert np.mean([after[i] >= 0.5 and before[i] < 0.5 for i in before]) < 0.02


def test_accepted_keeps_columns(spark, edge):
    model = quality.Model(np.zeros(quality.BUCKETS + 2), 0.0, 1.0)
    assert quality.accepted(edge, model).collect() == edge.collect()
    assert quality.accepted(edge, quality.Model(np.zeros(quality.BUCKETS + 2), 0.0, -1.0)).count() == 0


def test_the_twin_penalty_takes_weight_from_group_terms():
    terms = toxicity.term_features()["religion"]
    rng = np.random.default_rng(0)
    bags, named, label = [], [], []
    for k in range(400):  # in the sample, toxic texts name one group more often
        toxic = k % 4 == 0
        mention = rng.random() < (0.8 if toxic else 0.1)
        bag = [*rng.integers(1000, 60000, 12), *([77] if toxic and rng.random() < 0.7 else []), *(terms[0][1] if mention else [])]
        bags.append(np.unique(np.array(bag, np.int64)))
        named.append(np.array([terms[0][0]] if mention else [], np.uint64).view(np.int64))
        label.append(float(toxic))
    weight = {twin: np.abs(toxicity.train(bags, named, np.array(label), twin).weight[terms[0][1]].sum()) for twin in (0.0, 0.5)}
    assert weight[0.5] < 0.6 * weight[0.0]


def test_lstm_gradients():
    page = "<nav><a>x y</a></nav><article><p>one two.</p><p>three</p></article><footer>z</footer>"
    net = html_extract.Labeller(3)
    e = html_extract.Encoded([blocks_of(page), blocks_of("<p>a</p>")])
    target = np.array([0, 1, 1, 0, 1.0])
    _, grad = net.gradients(e, target)
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        spots = np.argwhere(np.abs(grad[name]) > 1e-9)
        for at in spots[rng.integers(len(spots), size=3)]:
            at = tuple(at)
            old = value[at]
            value[at] = old + 1e-5
            up = net.gradients(e, target)[0]
            value[at] = old - 1e-5
            down = net.gradients(e, target)[0]
            value[at] = old
            assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_blocks():
    texts = lambda p: [b.text for b in blocks_of(p)]
    assert texts("") == [] and texts("plain\n text") == ["plain text"]
    assert texts("<p>a &amp; b&nbsp;c<br>d<p>e <b>f</b>g") == ["a & b c", "d", "e fg"]
    assert texts("<script>var x='</p>'</script><style>p{}</style><!-- no --><p>x") == ["x"]
    assert texts("<p>x<!-- open <p>y") == ["x"] and texts("<p title='a>b'>z") == ["z"]


def test_formulas_and_figures_are_text():
    texts = lambda p: [b.text for b in blocks_of(p)]
    assert texts("<p>Energy <math><mi>E</mi>=<mi>mc</mi></math> holds") == ["Energy E=mc holds"]
    assert texts("<figure><svg><title>Growth</title><text>2020</text></svg><figcaption>A b</figcaption></figure>") == ["Growth2020", "A b"]
    assert texts("<head><title>no</title></head><body><object>shown <object>inner</object> too</object><noscript>plain</noscript>") == ["shown inner tooplain"]


def test_names_that_are_not_open_cost_nothing():
    import time
    began = time.time()
    page = "<p>" + "<span>" * 30000 + "x" + "</em>" * 30000 + "</i><p>" * 300
    assert [b.text for b in blocks_of(page)] == ["x"]
    assert time.time() - began < 20


def test_without_a_page_that_names_its_parts_all_blocks_stay(spark):
    pages = spark.createDataFrame([(1, "u", "<div><p>a</p><p>b &amp; c</p></div>"), (2, "u", None)], "page_id bigint, url string, html string")
    net = html_extract.fit(pages)
    assert net is None
    assert [r.text for r in html_extract.extract(pages, net).orderBy("page_id").collect()] == ["a b & c", ""]
    # a few usable pages among many others are found and learned from
    some = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select(F.col("page_id") + 1_000_000, "url", "html").limit(20)
    other = spark.range(2000).select("id", F.lit("u"), F.concat(F.lit("<div><p>no main part "), "id", F.lit("</p></div>")))
    assert html_extract.fit(other.union(some).toDF("page_id", "url", "html"), rows=20) is not None


def test_very_long_pages(spark):
    long = "<html><body><nav><a>x</a></nav><article>" + "<p>" + "many words here. " * 40000 + "</p>" + "</article></body></html>"
    net = html_extract.fit(spark.read.parquet(f"{SF_SMALL}/pages.parquet"))
    got = html_extract.extract(spark.createDataFrame([(1, "u", long)], "page_id bigint, url string, html string"), net).first()
    assert got.text == ("many words here. " * 40000).strip()


def test_extraction(spark):
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    net = html_extract.fit(pages)
    rows = {r.page_id: r for r in html_extract.extract(pages, net).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<(?:/?p|/?h1|br)\b[^>]*>", " ", body))).split())
        assert rows[r.page_id].text == want and rows[r.page_id].n_chars == len(want)
    odd = spark.createDataFrame([(1, None, None, 3), (2, "u", "", 3), (2, "u", "", 3), (3, None, "<p>" * 2000 + "x", 3)], "page_id bigint, url string, html string, n_chars int")
    assert [r.text for r in html_extract.extract(odd, net).orderBy("page_id").collect()][:3] == ["", "", ""]
    assert html_extract.extract(odd.limit(0), net).count() == 0
    shown = html_extract.labelled_text(['<html><body><header><h2>Site</h2></header><main><h1>T</h1><p>One is here.</p><p>Two.</p></main>'
                                        '<div class="comments"><p>I disagree!</p></div></body></html>'], net)
    assert shown == ["T One is here. Two."]
