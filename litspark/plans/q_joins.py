"""Registered queries: joins and record linkage (JN*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.functions import text as tx
from litspark.operators import joins as jn
from litspark.plans import sqlfrag as S
from litspark.plans.catalog import register
from litspark.plans.q_terms import cleaned_docs, tokens_of
from litspark.sources.tables import Tables


@register("jn1_left_join_counts", """
SELECT l.quality, CAST(count(*) AS BIGINT) AS n_docs
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY l.quality""")
def jn1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy("quality").agg(F.count(F.lit(1)).alias("n_docs"))


@register("jn2_right_join", S.with_(S.SCORES) + """
SELECT s.doc_id, l.quality, round(s.prediction_cult_prob_yes, 6) AS p_yes
FROM labels l RIGHT JOIN scores s USING (doc_id)""")
def jn2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.labels.select("doc_id", "quality").join(t.scores, "doc_id", "right")
    return j.select("doc_id", "quality", F.round("prediction_cult_prob_yes", 6).alias("p_yes"))


@register("jn3_12_keyed_predictions", S.with_(S.ARTICLES, S.SCORES) + """
SELECT a.doc_id, a.file_name, a.primary_subject, s.prediction_cult, s.prediction_relt, s.prediction_demog,
       s.prediction_orgs
FROM articles a JOIN scores s USING (doc_id)""")
def jn3_12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.articles.join(t.scores, "doc_id")
    return j.select("doc_id", "file_name", "primary_subject", "prediction_cult", "prediction_relt",
                    "prediction_demog", "prediction_orgs")


@register("jn4_left_join_renamed_keys", """
SELECT d.doc_id, d.lang, b.text AS passage FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id""")
def jn4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d, b = t.documents, t.benchmark
    j = d.join(b.select("item_id", F.col("text").alias("passage")), d.doc_id == b.item_id, "left").drop("item_id")
    return j.select("doc_id", "lang", "passage")


@register("jn4_left_join_labels", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def jn4_labels(spark, sf_dir):
    """Labels under another key name; unlabelled documents stay, the second key goes."""
    t = Tables(spark, sf_dir)
    l = t.labels.select(F.col("doc_id").alias("id"), "quality", "toxic")
    d = t.documents.select("doc_id", "lang")
    return d.join(l, d["doc_id"] == l["id"], "left").drop("id")


@register("jn5_one_to_one_violations", """
SELECT 'left' AS side, conv_id AS key, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1
UNION ALL
SELECT 'right', doc_id, CAST(count(*) AS BIGINT) FROM labels GROUP BY doc_id HAVING count(*) > 1""")
def jn5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    left = t.conversations.select(F.col("conv_id").alias("key"))
    right = t.labels.select(F.col("doc_id").alias("key"))
    return jn.one_to_one_report(left, right, ["key"]).select("side", "key", "n")


@register("jn6_join_with_fallback", S.with_(S.ARTICLES) + """
SELECT a.doc_id, a.publication_year AS year_raw, c.corrected_year, coalesce(c.corrected_year, a.publication_year) AS year
FROM articles a LEFT JOIN (SELECT doc_id, CAST(1971 + doc_id % 45 AS INTEGER) AS corrected_year FROM labels) c
  USING (doc_id)""")
def jn6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    corr = t.labels.select("doc_id", (F.lit(1971) + F.col("doc_id") % 45).cast("int").alias("corrected_year"))
    a = t.articles.select("doc_id", F.col("publication_year").alias("year_raw"))
    return jn.join_with_fallback(a, corr, ["doc_id"], "corrected_year", "year_raw", "year") \
        .select("doc_id", "year_raw", "corrected_year", "year")


CITE_TITLES_SQL = f"ct AS (SELECT cite_id, {S.normalize_title(S.CITE_TITLE)} AS title FROM citations)"


def _cite_titles(t: Tables):
    return t.citations.select("cite_id", tx.citation_title("citation").alias("title"))


@register("jn7_8_title_semi_anti", S.with_(S.citations_cte(), S.doc_titles_cte(), CITE_TITLES_SQL) + """
SELECT cite_id, 'matched' AS status FROM ct SEMI JOIN doc_titles USING (title)
UNION ALL
SELECT cite_id, 'unmatched' FROM ct ANTI JOIN doc_titles USING (title)""")
def jn7_8(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ct, dt = _cite_titles(t), t.doc_titles.select("title")
    return ct.join(dt, "title", "left_semi").select("cite_id", F.lit("matched").alias("status")).unionByName(
        ct.join(dt, "title", "left_anti").select("cite_id", F.lit("unmatched").alias("status")))


@register("jn9_staged_linkage", S.with_(S.citations_cte(), S.doc_titles_cte(), CITE_TITLES_SQL, S.ARTICLES) + """,
first AS (SELECT d.doc_id, d.title FROM doc_titles d JOIN articles a USING (doc_id) WHERE a.primary_subject = 'Sociology'),
m1 AS (SELECT ct.cite_id, first.doc_id, 1 AS stage FROM ct JOIN first USING (title)),
rest AS (SELECT * FROM ct ANTI JOIN first USING (title)),
m2 AS (SELECT rest.cite_id, d.doc_id, 2 AS stage FROM rest JOIN doc_titles d USING (title))
SELECT cite_id, doc_id, CAST(stage AS INTEGER) AS stage FROM m1 UNION ALL SELECT cite_id, doc_id, CAST(stage AS INTEGER) FROM m2""")
def jn9(spark, sf_dir):
    t = Tables(spark, sf_dir)
    first = t.doc_titles.join(t.articles.where(F.col("primary_subject") == "Sociology").select("doc_id"), "doc_id")
    out = jn.staged_link(_cite_titles(t), first, t.doc_titles, "title")
    return out.select("cite_id", "doc_id", F.col("stage").cast("int").alias("stage"))


@register("jn10_fuzzy_closest_title", S.with_(S.citations_cte(), S.doc_titles_cte(), CITE_TITLES_SQL) + f""",
un AS (SELECT * FROM ct ANTI JOIN doc_titles USING (title)),
sc AS (SELECT un.cite_id, d.doc_id, {S.fold_accents('un.title')} AS a, {S.fold_accents('d.title')} AS b FROM un CROSS JOIN doc_titles d),
sim AS (SELECT cite_id, doc_id, CAST(CASE WHEN greatest(length(a), length(b)) = 0 THEN 100
  ELSE round(100.0 * (1.0 - levenshtein(a, b) / greatest(length(a), length(b)))) END AS INTEGER) AS similarity FROM sc),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cite_id ORDER BY similarity DESC, doc_id) AS r FROM sim) WHERE r = 1)
SELECT un.cite_id, doc_id, similarity FROM un LEFT JOIN best USING (cite_id)""")
def jn10(spark, sf_dir):
    """One row per unmatched citation title; nulls where no name qualifies."""
    t = Tables(spark, sf_dir)
    ct = _cite_titles(t)
    un = ct.join(t.doc_titles.select("title"), "title", "left_anti").withColumnRenamed("title", "a")
    best = jn.closest_title(un, "cite_id", "a", t.doc_titles.withColumnRenamed("title", "b"), "doc_id", "b")
    return best.select("cite_id", "doc_id", "similarity")


@register("jn11_fragment_in_documents", f"""
WITH fr AS (SELECT item_id, array_to_string(list_slice(tk, 1, 3), ' ') AS frag
            FROM (SELECT item_id, {S.tokenize('text')} AS tk FROM benchmark) WHERE len(tk) >= 3),
dt AS (SELECT doc_id, ' ' || array_to_string({S.tokenize('text')}, ' ') || ' ' AS flat FROM documents)
SELECT item_id, CAST(count(*) AS BIGINT) AS n_docs
FROM fr JOIN dt ON contains(dt.flat, ' ' || fr.frag || ' ') GROUP BY item_id""")
def jn11(spark, sf_dir):
    t = Tables(spark, sf_dir)
    fr = t.benchmark.select("item_id", tx.tokenize("text").alias("tk"))
    dt = t.documents.select("doc_id", tx.tokenize("text").alias("tk"))
    m = jn.fragment_matches(fr, "item_id", "tk", dt, "doc_id", "tk", n=3)
    return m.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


@register("jn14_token_vector_lookup", "WITH " + S.CLEAN_TOKENS + """,
wv AS (SELECT term, vec_id FROM (SELECT term, row_number() OVER (ORDER BY cnt DESC, term) - 1 AS vec_id
       FROM (SELECT term, count(*) AS cnt FROM ctok GROUP BY term)) JOIN embeddings USING (vec_id))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_known FROM ctok JOIN wv USING (term) GROUP BY doc_id""")
def jn14(spark, sf_dir):
    from litspark.operators.vectors import word_vectors
    t = Tables(spark, sf_dir)
    tok = tokens_of(cleaned_docs(t))
    wv = word_vectors(tok, t.embeddings)
    # frequent terms are hot keys; the vector vocabulary is size-checked and broadcast
    return tok.join(wv.select("term"), "term").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_known"))


@register("jn15_fetch_with_duplicates", S.with_(S.ARTICLES, S.SCORES) + """,
keys AS (SELECT doc_id, 'cult' AS pool FROM scores WHERE prediction_cult_prob_yes > 0.8
         UNION ALL SELECT doc_id, 'relt' FROM scores WHERE prediction_relt_prob_yes > 0.8)
SELECT k.doc_id, k.pool, a.journal_title FROM keys k JOIN articles a USING (doc_id)""")
def jn15(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = t.scores
    keys = s.where(F.col("prediction_cult_prob_yes") > 0.8).select("doc_id", F.lit("cult").alias("pool")).unionByName(
        s.where(F.col("prediction_relt_prob_yes") > 0.8).select("doc_id", F.lit("relt").alias("pool")))
    return keys.join(t.articles.select("doc_id", "journal_title"), "doc_id").select("doc_id", "pool", "journal_title")

