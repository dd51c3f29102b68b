"""Registered queries: filters and predicates (FLT*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.functions import text as tx
from litspark.operators import dictionary as dc
from litspark.operators import filters as fl
from litspark.plans import sqlfrag as S
from litspark.plans.catalog import register
from litspark.plans.q_text import PAIRS_SQL, SIM_SQL, title_pairs
from litspark.sources.dictionaries import all_terms, dictionary_table
from litspark.sources.tables import PERSPECTIVES, Tables


@register("flt1_not_null", S.with_(S.ARTICLES, S.CODED) + """
SELECT a.doc_id, a.publication_year, c.cultural_score
FROM articles a JOIN coded c USING (doc_id)
WHERE a.publication_year IS NOT NULL AND a.journal_title IS NOT NULL AND c.cultural_score IS NOT NULL""")
def flt1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.articles.join(t.coded, "doc_id")
    return j.where(F.col("publication_year").isNotNull() & F.col("journal_title").isNotNull()
                   & F.col("cultural_score").isNotNull()).select("doc_id", "publication_year", "cultural_score")


@register("flt2_3_subject_filters", S.with_(S.ARTICLES) + """
SELECT journal_title, CAST(count(*) FILTER (WHERE primary_subject IN ('Sociology')) AS BIGINT) AS n_listed,
       CAST(count(*) FILTER (WHERE contains(primary_subject, 'Sociology')) AS BIGINT) AS n_contains
FROM articles GROUP BY journal_title""")
def flt2_3(spark, sf_dir):
    a = Tables(spark, sf_dir).articles
    return a.groupBy("journal_title").agg(
        F.count_if(F.col("primary_subject").isin("Sociology")).alias("n_listed"),
        F.count_if(F.col("primary_subject").contains("Sociology")).alias("n_contains"))


@register("flt4_dictionary_filter", S.with_(S.ARTICLES) + f"""
SELECT primary_subject, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS n_kept,
       CAST(count(*) FILTER (WHERE NOT hit) AS BIGINT) AS n_removed
FROM (SELECT primary_subject, len(list_filter({S.lst(all_terms())}, lambda t: contains(text, t))) > 0 AS hit
      FROM articles)
GROUP BY primary_subject""")
def flt4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.articles.select("primary_subject", "doc_id").join(
        dc.with_hits(t.documents.select("doc_id", "text"), "doc_id", "text", dictionary_table(spark)).select("doc_id", "hit"), "doc_id")
    return a.groupBy("primary_subject").agg(F.count_if("hit").alias("n_kept"),
                                            F.count_if(~F.col("hit")).alias("n_removed"))


@register("flt5_drop_unsure", """
SELECT doc_id, score FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 0.5 ELSE CAST(quality AS DOUBLE) END AS score FROM labels)
WHERE score IN (0.0, 1.0)""")
def flt5(spark, sf_dir):
    l = Tables(spark, sf_dir).labels.select(
        "doc_id", F.when(F.col("toxic") == 1, F.lit(0.5)).otherwise(F.col("quality").cast("double")).alias("score"))
    return l.where(F.col("score").isin(0.0, 1.0))


# Per (subject, perspective) thresholds: fixed parameters of the sampling step.
THRESHOLDS = [("Sociology", "cult", 0.8, 0.3), ("Sociology", "relt", 0.75, 0.25),
              ("Management & Organizational Behavior", "cult", 0.7, 0.2),
              ("Management & Organizational Behavior", "relt", 0.85, 0.35)]


def _long_scores(t: Tables, persps=("cult", "relt", "demog", "orgs")):
    s = t.scores
    return s.select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(p).alias("perspective"), F.col(f"prediction_{p}_prob_yes").alias("p_yes"))
        for p in persps])).alias("x")).select("doc_id", "x.*")


def _long_scores_sql(persps=("cult", "relt", "demog", "orgs")):
    return "long AS (" + " UNION ALL ".join(
        f"SELECT doc_id, '{p}' AS perspective, prediction_{p}_prob_yes AS p_yes FROM scores" for p in persps) + ")"


def _thr_sql():
    return "thr AS (SELECT * FROM (VALUES " + ", ".join(
        f"({S.q(a)}, {S.q(b)}, {c}, {d})" for a, b, c, d in THRESHOLDS) + \
        ") AS v(primary_subject, perspective, t_min, t_maj))"


@register("flt6_threshold_pools", S.with_(S.ARTICLES, S.SCORES, _long_scores_sql(), _thr_sql()) + """
SELECT l.doc_id, l.perspective, CASE WHEN l.p_yes > t.t_min THEN 'minority' ELSE 'majority' END AS pool,
       round(l.p_yes, 6) AS p_yes
FROM long l JOIN articles a USING (doc_id) JOIN thr t ON t.primary_subject = a.primary_subject AND t.perspective = l.perspective
WHERE l.p_yes > t.t_min OR l.p_yes < t.t_maj""")
def flt6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    thr = spark.createDataFrame(THRESHOLDS, "primary_subject string, perspective string, t_min double, t_maj double")
    j = _long_scores(t).join(t.articles.select("doc_id", "primary_subject"), "doc_id") \
        .join(F.broadcast(thr), ["primary_subject", "perspective"])  # fixed parameter table
    j = j.where((F.col("p_yes") > F.col("t_min")) | (F.col("p_yes") < F.col("t_maj")))
    return j.select("doc_id", "perspective",
                    F.when(F.col("p_yes") > F.col("t_min"), "minority").otherwise("majority").alias("pool"),
                    F.round("p_yes", 6).alias("p_yes"))


@register("flt7_orgsoc_gate", S.with_(S.ARTICLES, S.SCORES) + """
SELECT doc_id, CAST(prediction_orgs_prob_yes > 0.5 AS BOOLEAN) AS gate_05, prediction_orgs_prob_yes > 0.7 AS gate_07
FROM articles JOIN scores USING (doc_id)
WHERE primary_subject = 'Sociology' AND prediction_orgs_prob_yes > 0.5""")
def flt7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.articles.join(t.scores, "doc_id")
    j = j.where((F.col("primary_subject") == "Sociology") & (F.col("prediction_orgs_prob_yes") > 0.5))
    return j.select("doc_id", (F.col("prediction_orgs_prob_yes") > 0.5).alias("gate_05"),
                    (F.col("prediction_orgs_prob_yes") > 0.7).alias("gate_07"))


@register("flt8_fuzzy_predictions", S.with_(S.SCORES) + "SELECT doc_id, " + ", ".join(
    f"abs(2.0 * prediction_{p}_prob_yes - 1.0) BETWEEN 0.1 AND 0.5 AS fuzzy_{p}" for p in PERSPECTIVES) +
    ", " + " OR ".join(f"abs(2.0 * prediction_{p}_prob_yes - 1.0) BETWEEN 0.1 AND 0.5" for p in PERSPECTIVES) +
    " AS any_fuzzy FROM scores")
def flt8(spark, sf_dir):
    s = Tables(spark, sf_dir).scores
    cols = [fl.fuzzy_prediction(F.col(f"prediction_{p}_prob_yes")).alias(f"fuzzy_{p}") for p in PERSPECTIVES]
    out = s.select("doc_id", *cols)
    any_ = None
    for p in PERSPECTIVES:
        any_ = F.col(f"fuzzy_{p}") if any_ is None else any_ | F.col(f"fuzzy_{p}")
    return out.withColumn("any_fuzzy", any_)


@register("flt9_similarity_gate", PAIRS_SQL + f"""
SELECT cite_id, similarity FROM (SELECT cite_id, {SIM_SQL} AS similarity FROM pairs) WHERE similarity > 65""")
def flt9(spark, sf_dir):
    s = title_pairs(Tables(spark, sf_dir)).select("cite_id", tx.similarity_ratio("a", "b").alias("similarity"))
    return s.where(F.col("similarity") > 65)


@register("flt10_11_median_bands", """
WITH ev AS (SELECT event_id, event_type, value FROM events WHERE NOT isnan(value)),
st AS (SELECT event_type, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS std FROM ev GROUP BY event_type)
SELECT event_id, event_type, band FROM (
  SELECT e.event_id, e.event_type,
    CASE WHEN e.value > median - std AND e.value < median THEN 'below'
         WHEN e.value > median AND e.value < median + std THEN 'above' END AS band
  FROM ev e JOIN st USING (event_type)) WHERE band IS NOT NULL""")
def flt10_11(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("event_id", "event_type", "value")
    return fl.band_around_median(e, "value", ["event_type"]).select("event_id", "event_type", "band")


@register("flt12_positives", "SELECT doc_id FROM labels WHERE quality = 1")
def flt12(spark, sf_dir):
    return Tables(spark, sf_dir).labels.where(F.col("quality") == 1).select("doc_id")


@register("flt13_valid_urls", """
SELECT page_id, url FROM pages WHERE url <> 'external-fulltext-any' AND url IS NOT NULL""")
def flt13(spark, sf_dir):
    p = Tables(spark, sf_dir).pages
    return p.where((F.col("url") != "external-fulltext-any") & F.col("url").isNotNull()).select("page_id", "url")


@register("flt13_placeholder_urls", """
SELECT page_id, link FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'external-fulltext-any' WHEN page_id % 11 <> 0 THEN url END AS link FROM pages)
WHERE link <> 'external-fulltext-any' AND link IS NOT NULL""")
def flt13_placeholders(spark, sf_dir):
    """Pages of which some have the placeholder for a link and some none."""
    link = F.when(F.col("page_id") % 7 == 0, F.lit("external-fulltext-any")).when(F.col("page_id") % 11 != 0, F.col("url"))
    p = Tables(spark, sf_dir).pages.select("page_id", link.alias("link"))
    return p.where((F.col("link") != "external-fulltext-any") & F.col("link").isNotNull())
