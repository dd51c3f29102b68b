"""Registered queries: aggregations (AGG1-AGG21, AGG26)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litspark.functions import text as tx
from litspark.operators import aggregates as ag
from litspark.operators import dictionary as dc
from litspark.operators.vectors import word_vectors
from litspark.plans import sqlfrag as S
from litspark.plans.catalog import register
from litspark.plans.q_filters import _long_scores, _long_scores_sql
from litspark.plans.q_terms import clean_tokens, cleaned_docs
from litspark.session import reuse, small_result
from litspark.sources.dictionaries import DICTIONARIES, dictionary_table
from litspark.sources.tables import PERSPECTIVES, Tables

N = "CAST(count(*) AS BIGINT)"


@register("agg1_label_distribution", f"SELECT quality, toxic, {N} AS n FROM labels GROUP BY quality, toxic")
def agg1(spark, sf_dir):
    return Tables(spark, sf_dir).labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@register("agg2_value_counts", f"SELECT source, {N} AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def agg2(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@register("agg3_positives_per_year", S.with_(S.ARTICLES, S.SCORES) + f"""
SELECT publication_year AS year, {N} AS n_positive FROM (
  SELECT doc_id, publication_year FROM articles JOIN scores USING (doc_id)
  WHERE primary_subject = 'Sociology' AND prediction_cult = 'yes'
  UNION ALL
  SELECT doc_id, publication_year FROM articles JOIN scores USING (doc_id)
  WHERE primary_subject <> 'Sociology' AND prediction_cult = 'yes') GROUP BY publication_year""")
def agg3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.articles.join(t.scores, "doc_id").where(F.col("prediction_cult") == "yes")
    soc = j.where(F.col("primary_subject") == "Sociology").select("doc_id", "publication_year")
    mgt = j.where(F.col("primary_subject") != "Sociology").select("doc_id", "publication_year")
    return soc.unionByName(mgt).groupBy(F.col("publication_year").alias("year")).agg(
        F.count(F.lit(1)).alias("n_positive"))


@register("agg4_yearly_proportion", S.with_(S.ARTICLES, S.SCORES) + """,
j AS (SELECT * FROM articles JOIN scores USING (doc_id)),
bases AS (SELECT 'sociology' AS base, * FROM j WHERE primary_subject = 'Sociology'
          UNION ALL SELECT 'management', * FROM j WHERE primary_subject <> 'Sociology'
          UNION ALL SELECT 'orgsoc', * FROM j WHERE primary_subject = 'Sociology' AND prediction_orgs_prob_yes > 0.5),
b AS (SELECT base, publication_year AS year, count(*) AS n_base FROM bases GROUP BY ALL),
c AS (SELECT base, publication_year AS year, count(*) AS n_category FROM bases WHERE prediction_cult = 'yes' GROUP BY ALL)
SELECT base, year, CAST(n_base AS BIGINT) AS n_base, CAST(coalesce(n_category, 0) AS BIGINT) AS n_category,
       round(coalesce(n_category, 0) / n_base, 6) AS proportion
FROM b LEFT JOIN c USING (base, year)""")
def agg4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.articles.join(t.scores, "doc_id").withColumnRenamed("publication_year", "year")
    soc = F.col("primary_subject") == "Sociology"
    bases = {"sociology": j.where(soc), "management": j.where(~soc),
             "orgsoc": j.where(soc & (F.col("prediction_orgs_prob_yes") > 0.5))}
    out = None
    for name, b in bases.items():
        p = ag.yearly_proportion(b, b.where(F.col("prediction_cult") == "yes"), "year").withColumn("base", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out.select("base", "year", "n_base", "n_category", F.round("proportion", 6).alias("proportion"))


def _pct_sql(group_expr: str, group_name: str, source: str):
    return f"""
SELECT {group_name}, perspective, stat, round(value, 6) AS value FROM (
  SELECT {group_expr} AS {group_name}, perspective,
         quantile_cont(p_yes, 0.25) AS q25, quantile_cont(p_yes, 0.5) AS q50, quantile_cont(p_yes, 0.75) AS q75,
         avg(p_yes) AS mean
  FROM {source} GROUP BY ALL)
UNPIVOT (value FOR stat IN (q25, q50, q75, mean))"""


def _pct_spark(df, group: list[str], with_mean: bool = True):
    q = ag.exact_percentiles(df, "p_yes", group, [0.25, 0.5, 0.75])
    q = q.select(*group, F.concat(F.lit("q"), (F.col("p") * 100).cast("int").cast("string")).alias("stat"), "value")
    if with_mean:
        m = df.groupBy(*group).agg(F.avg("p_yes").alias("value")).withColumn("stat", F.lit("mean"))
        q = q.unionByName(m.select(*group, "stat", "value"))
    return q.select(*group, "stat", F.round("value", 6).alias("value"))


@register("agg5_6_yearly_percentiles_and_mean",
          S.with_(S.ARTICLES, S.SCORES, _long_scores_sql(), "src AS (SELECT * FROM long JOIN articles USING (doc_id))")
          + _pct_sql("publication_year", "year", "src"))
def agg5_6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    src = _long_scores(t).join(t.articles.select("doc_id", F.col("publication_year").alias("year")), "doc_id")
    return _pct_spark(src, ["year", "perspective"])


@register("agg7_quartiles_per_subject", S.with_(S.ARTICLES, S.SCORES, _long_scores_sql(),
                                                "src AS (SELECT * FROM long JOIN articles USING (doc_id))") + """
SELECT primary_subject, perspective, stat, round(value, 6) AS value FROM (
  SELECT primary_subject, perspective, quantile_cont(p_yes, 0.25) AS q25, quantile_cont(p_yes, 0.5) AS q50,
         quantile_cont(p_yes, 0.75) AS q75 FROM src GROUP BY ALL)
UNPIVOT (value FOR stat IN (q25, q50, q75))""")
def agg7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    src = _long_scores(t).join(t.articles.select("doc_id", "primary_subject"), "doc_id")
    return _pct_spark(src, ["primary_subject", "perspective"], with_mean=False)


@register("agg8_vocabulary_size", S.with_(S.SENTS, S.TOKENS) + """
SELECT d.lang, CAST(count(DISTINCT t.token) AS BIGINT) AS n_vocab FROM tokens t JOIN documents d USING (doc_id) GROUP BY d.lang""")
def agg8(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tok = F.explode(F.flatten(F.transform(tx.sentences("text"), lambda s: tx.tokenize(s)))).alias("token")
    return t.documents.select("lang", tok).groupBy("lang").agg(F.countDistinct("token").alias("n_vocab"))


# Five standard errors of the sketches.
HLL_WITHIN = 5 * 0.0065


@register("agg8_mergeable_vocabulary_size", S.with_(S.ARTICLES, S.SENTS, S.TOKENS) + f"""
SELECT slice, n_vocab, true AS within FROM (
  SELECT primary_subject AS slice, CAST(count(DISTINCT token) AS BIGINT) AS n_vocab FROM tokens JOIN articles USING (doc_id) GROUP BY 1
  UNION ALL SELECT CAST(publication_year // 10 * 10 AS VARCHAR), CAST(count(DISTINCT token) AS BIGINT) FROM tokens JOIN articles USING (doc_id) GROUP BY 1
  UNION ALL SELECT 'all', CAST(count(DISTINCT token) AS BIGINT) FROM tokens)""")
def agg8_sketches(spark, sf_dir):
    """Vocabulary sizes of coarser slices, merged from one stored sketch per
    (subject, year), beside the exact counts: ``within`` tells whether the
    estimate lies in its error bound."""
    tok = F.explode(F.flatten(F.transform(tx.sentences("text"), lambda s: tx.tokenize(s)))).alias("token")
    each = Tables(spark, sf_dir).articles.select("primary_subject", "publication_year", tok)
    decade = (F.floor(F.col("publication_year") / 10) * 10).cast("int").cast("string")
    words = reuse(each.distinct())
    stored = small_result(ag.distinct_sketches(words, ["primary_subject", "publication_year"], "token"))  # the only pass over the tokens
    out = None
    for column in (F.col("primary_subject"), decade, F.lit("all")):
        exact = words.select(column.alias("slice"), "token").groupBy("slice").agg(F.countDistinct("token").alias("n_vocab"))
        both = ag.merged_distinct(stored.withColumn("slice", column), ["slice"]).join(exact, "slice")
        out = both if out is None else out.unionByName(both)
    return out.select("slice", "n_vocab", (F.abs(F.col("n_distinct") - F.col("n_vocab")) <= F.greatest(F.lit(1.0), HLL_WITHIN * F.col("n_vocab"))).alias("within"))


def _top_terms(counts, group, k):
    """k most frequent terms per group (ties by term); a vocabulary-sized group
    is never sorted in one task (see ``windows.top_k``)."""
    from litspark.operators.windows import top_k
    return top_k(counts, group, F.col("n"), k, [F.col("term").asc()])


@register("agg9_top_terms", "WITH " + S.CLEAN_TOKENS + f""",
c AS (SELECT CAST(l.quality AS VARCHAR) AS class, term, count(*) AS n FROM ctok JOIN labels l USING (doc_id) GROUP BY ALL
      UNION ALL SELECT 'all', term, count(*) FROM ctok GROUP BY term)
SELECT class, term, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 20""")
def agg9(spark, sf_dir):
    t = Tables(spark, sf_dir)
    docs = cleaned_docs(t)
    # labels meet documents, not tokens
    per = docs.join(t.labels.select("doc_id", F.col("quality").cast("string").alias("class")), "doc_id") \
        .select("class", F.explode(tx.flatten_tokens("doc")).alias("term")).groupBy("class", "term").agg(F.count(F.lit(1)).alias("n"))
    allc = docs.select(F.explode(tx.flatten_tokens("doc")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("class", F.lit("all"))
    return _top_terms(per.unionByName(allc), ["class"], 20).select("class", "term", "n", "rank")


@register("agg10_top_sentences", S.with_(S.SENTS) + """
SELECT sentence, CAST(n AS BIGINT) AS n FROM (SELECT trim(sentence) AS sentence, count(*) AS n FROM sents
  WHERE trim(sentence) <> '' GROUP BY 1) ORDER BY n DESC, sentence LIMIT 100""")
def agg10(spark, sf_dir):
    s = Tables(spark, sf_dir).sents.select(F.trim("sentence").alias("sentence")).where(F.col("sentence") != "")
    return s.groupBy("sentence").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sentence").limit(100)


@register("agg11_ngram_counts", f"""
WITH cl AS (SELECT doc_id, flatten({S.clean_document('text')}) AS tk FROM documents),
bi AS (SELECT tk[i] || ' ' || tk[i + 1] AS term FROM (SELECT tk, unnest(generate_series(1, len(tk) - 1)) AS i FROM cl WHERE len(tk) > 1)),
uni AS (SELECT unnest(tk) AS term FROM cl),
c AS (SELECT 2 AS n_words, term, count(*) AS n FROM bi GROUP BY term UNION ALL SELECT 1, term, count(*) FROM uni GROUP BY term)
SELECT CAST(n_words AS INTEGER) AS n_words, term, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY n_words ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 30""")
def agg11(spark, sf_dir):
    d = cleaned_docs(Tables(spark, sf_dir)).select(tx.flatten_tokens("doc").alias("tk"))
    # bigrams inside each row: no window, no shuffle before the count
    from litspark.operators.terms import _adjacent
    # adjacent pairs inside each row (arrays_zip: no lambda), counted as "a b"
    bi = d.select(F.explode(_adjacent(F.col("tk"))).alias("p")) \
        .groupBy(F.concat_ws(" ", "p.a", "p.b").alias("term")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("n_words", F.lit(2))
    uni = d.select(F.explode("tk").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("n_words", F.lit(1))
    return _top_terms(bi.unionByName(uni), ["n_words"], 30).select("n_words", "term", "n", "rank")


@register("agg12_document_lengths", f"""
WITH wc AS (SELECT lang, {S.WC_EXPR('text')} AS n_words FROM documents)
SELECT lang, CAST(max(n_words) AS INTEGER) AS max_words, round(avg(n_words), 6) AS avg_words, {N} AS n_docs
FROM wc GROUP BY lang""")
def agg12(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.withColumn("n_words", tx.word_count("text"))
    return d.groupBy("lang").agg(F.max("n_words").alias("max_words"), F.round(F.avg("n_words"), 6).alias("avg_words"),
                                 F.count(F.lit(1)).alias("n_docs"))


@register("agg13_share_above_threshold", S.with_(S.SCORES, _long_scores_sql()) + """
SELECT perspective, CAST(count(*) FILTER (WHERE p_yes > 0.5) AS BIGINT) AS n_above,
       round(100.0 * count(*) FILTER (WHERE p_yes > 0.5) / count(*), 6) AS pct_above
FROM long GROUP BY perspective""")
def agg13(spark, sf_dir):
    l = _long_scores(Tables(spark, sf_dir))
    return l.groupBy("perspective").agg(F.count_if(F.col("p_yes") > 0.5).alias("n_above"),
                                        F.round(F.lit(100.0) * F.count_if(F.col("p_yes") > 0.5) / F.count(F.lit(1)), 6)
                                        .alias("pct_above"))


AGG14_TARGET = 100


@register("agg14_grid_threshold", S.with_(S.SCORES, _long_scores_sql()) + f""",
grid AS (SELECT perspective, k, (SELECT count(*) FROM long l WHERE l.perspective = p.perspective
                AND round(l.p_yes * 1000, 6) > 500 + k) AS n_exceed
         FROM (SELECT DISTINCT perspective FROM long) p, range(0, 501) r(k))
SELECT perspective, CAST(round(0.5 + 0.001 * min(k), 6) AS DOUBLE) AS threshold FROM grid WHERE n_exceed <= {AGG14_TARGET}
GROUP BY perspective""")
def agg14(spark, sf_dir):
    l = _long_scores(Tables(spark, sf_dir))
    x = F.round(F.col("p_yes") * 1000, 6)
    # largest grid index k with x > 500 + k (clipped to -1..500): a bounded key
    kmax = F.least(F.greatest(F.ceil(x - 500) - 1, F.lit(-1)), F.lit(500)).cast("int")
    h = l.groupBy("perspective", kmax.alias("kmax")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("perspective").orderBy(F.desc("kmax")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("above_or_eq", F.sum("c").over(w))  # <= 501 rows per perspective
    # candidate k = kmax + 1 exceeded by rows with larger kmax; k = 0 by all rows with kmax >= 0
    cand = h.select("perspective", (F.col("kmax") + 1).alias("k"), (F.col("above_or_eq") - F.col("c")).alias("n_exceed"))
    zero = h.where(F.col("kmax") >= 0).groupBy("perspective").agg(F.sum("c").alias("n_exceed")).withColumn("k", F.lit(0))
    allp = l.select("perspective").distinct().withColumn("k", F.lit(0)).withColumn("n_exceed", F.lit(0).cast("long"))
    zero = allp.join(zero.select("perspective", F.col("n_exceed").alias("nz")), "perspective", "left") \
        .select("perspective", "k", F.coalesce("nz", "n_exceed").alias("n_exceed"))
    c = cand.unionByName(zero.select("perspective", "k", "n_exceed"))
    # the grid ends at 1.000, which no probability exceeds
    c = c.where((F.col("k") >= 0) & (F.col("k") <= 500) & (F.col("n_exceed") <= AGG14_TARGET))
    return c.groupBy("perspective").agg(F.round(F.lit(0.5) + F.lit(0.001) * F.min("k"), 6).alias("threshold"))


HIST_SQL = """r AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type),
h AS (SELECT e.event_type, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin,
             count(*) AS cnt, any_value(lo) AS lo, any_value(hi) AS hi
      FROM events e JOIN r USING (event_type) GROUP BY ALL)"""


@register("agg15_histogram", "WITH " + HIST_SQL + """
SELECT event_type, bin, CAST(cnt AS BIGINT) AS count, round(lo + bin * (hi - lo) / 50, 6) AS left_edge FROM h""")
def agg15(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    h = ag.histogram(e, "value", 50, ["event_type"])
    return h.select("event_type", "bin", "count", F.round("left", 6).alias("left_edge"))


@register("agg16_histogram_cdf_quartiles", "WITH " + HIST_SQL + """,
c AS (SELECT event_type, bin, lo, hi, sum(cnt) OVER (PARTITION BY event_type ORDER BY bin) / sum(cnt) OVER (PARTITION BY event_type) AS cdf FROM h),
q AS (SELECT CAST(q AS DOUBLE) AS q FROM (VALUES (0.25), (0.5), (0.75)) v(q))
SELECT event_type, q, round(arg_min(lo + (bin + 0.5) * (hi - lo) / 50, abs(cdf - q) * 1000 + bin / 1000000.0), 6) AS x
FROM c, q GROUP BY event_type, q""")
def agg16(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    h = ag.histogram(e, "value", 50, ["event_type"])
    rng = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    h = h.join(rng, "event_type")  # one row per type
    w = Window.partitionBy("event_type").orderBy("bin")  # <= 50 rows per type
    h = h.withColumn("cdf", F.sum("count").over(w) / F.sum("count").over(Window.partitionBy("event_type")))
    qs = F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])
    h = h.withColumn("q", F.explode(qs))
    center = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / 50
    key = F.abs(F.col("cdf") - F.col("q")) * 1000 + F.col("bin") / 1000000.0
    return h.groupBy("event_type", "q").agg(F.round(F.min_by(center, key), 6).alias("x"))


@register("agg17_19_moments", """
SELECT event_type, round(skewness(value), 6) AS skew, round(quantile_cont(value, 0.5), 6) AS median,
       round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type""")
def agg17_19(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    m = e.groupBy("event_type").agg(F.round(ag.skewness_corrected("value"), 6).alias("skew"),
                                    F.round(F.stddev_pop("value"), 6).alias("std"))
    med = ag.exact_percentiles(e, "value", ["event_type"], [0.5]).select("event_type", F.round("value", 6).alias("median"))
    return m.join(med, "event_type").select("event_type", "skew", "median", "std")


@register("agg18_correlation_matrix", S.with_(S.SCORES) + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(prediction_{a}_prob_yes, prediction_{b}_prob_yes), 6) AS corr FROM scores"
    for a in PERSPECTIVES for b in PERSPECTIVES))
def agg18(spark, sf_dir):
    s = Tables(spark, sf_dir).scores
    aggs = [F.round(F.corr(f"prediction_{a}_prob_yes", f"prediction_{b}_prob_yes"), 6).alias(f"{a}__{b}")
            for a in PERSPECTIVES for b in PERSPECTIVES]
    wide = s.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("corr"))
                                for a in PERSPECTIVES for b in PERSPECTIVES]))
    return wide.select(stack.alias("x")).select("x.*")


@register("agg20_dictionary_coverage", "WITH " + S.CLEAN_TOKENS + """,
wv AS (SELECT term FROM (SELECT term, row_number() OVER (ORDER BY cnt DESC, term) - 1 AS vec_id
       FROM (SELECT term, count(*) AS cnt FROM ctok GROUP BY term)) JOIN embeddings USING (vec_id)),
dict AS (SELECT * FROM (VALUES """ + ", ".join(f"({S.q(p)}, {S.q(t)})" for p, ts in DICTIONARIES.items() for t in ts) + """) v(perspective, term))
SELECT perspective, CAST(count(*) AS BIGINT) AS n_terms, CAST(count(wv.term) AS BIGINT) AS n_found
FROM dict LEFT JOIN wv USING (term) GROUP BY perspective""")
def agg20(spark, sf_dir):
    t = Tables(spark, sf_dir)
    wv = word_vectors(clean_tokens(t), t.embeddings).select("term", F.lit(1).alias("found"))
    d = dictionary_table(spark).join(wv, "term", "left")
    return d.groupBy("perspective").agg(F.count(F.lit(1)).alias("n_terms"), F.count("found").alias("n_found"))


@register("agg21_audit_counts", S.with_(S.ARTICLES) + f"""
SELECT 'documents' AS step, {N} AS n_rows FROM articles
UNION ALL SELECT 'with_year', {N} FROM articles WHERE publication_year IS NOT NULL
UNION ALL SELECT 'dictionary_hit', {N} FROM articles WHERE len(list_filter({S.lst([t for ts in DICTIONARIES.values() for t in ts])}, lambda t: contains(text, t))) > 0
UNION ALL SELECT 'labelled', {N} FROM articles WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'long_enough', {N} FROM articles WHERE length(text) >= 1000""")
def agg21(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hits = dc.with_hits(t.documents.select("doc_id", "text"), "doc_id", "text", dictionary_table(spark)).select("doc_id", "hit")
    a = t.articles.select("doc_id", "publication_year", F.length("text").alias("length")).join(hits, "doc_id").join(
        t.labels.select("doc_id", F.lit(1).alias("lab")), "doc_id", "left")
    one = a.agg(F.count(F.lit(1)).alias("documents"),
                F.count_if(F.col("publication_year").isNotNull()).alias("with_year"),
                F.count_if("hit").alias("dictionary_hit"),
                F.count_if(F.col("lab").isNotNull()).alias("labelled"),
                F.count_if(F.col("length") >= 1000).alias("long_enough"))
    names = ["documents", "with_year", "dictionary_hit", "labelled", "long_enough"]
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("step"), F.col(n).alias("n_rows")) for n in names]))
    return one.select(stack.alias("x")).select("x.*")


_DICT_SQL = ", ".join(f"({S.q(p)}, {S.q(t)})" for p, ts in DICTIONARIES.items() for t in ts)


@register("agg26_dictionary_hits_per_doc", f"""
WITH clean AS (SELECT doc_id, {S.clean_document('text')} AS doc FROM documents),
cs AS (SELECT doc_id, unnest(doc) AS toks FROM clean),
dict AS (SELECT perspective, string_split(term, ' ') AS words FROM (VALUES {_DICT_SQL}) v(perspective, term)),
spots AS (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM cs)
SELECT doc_id, perspective, CAST(count(*) AS BIGINT) AS n_hits
FROM spots JOIN dict ON toks[i] = words[1] AND toks[i:i + len(words) - 1] = words GROUP BY ALL""")
def agg26(spark, sf_dir):
    sents = cleaned_docs(Tables(spark, sf_dir)).select("doc_id", F.explode("doc").alias("toks"))
    return dc.hit_counts(sents, ["doc_id"], "toks", dictionary_table(spark))
