"""Registered queries: nearest-k, slices, sorts, limits and set operations
(WIN*, SET*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.functions import text as tx
from litspark.operators import aggregates as ag
from litspark.operators import sampling as sm
from litspark.operators import windows as wn
from litspark.plans import sqlfrag as S
from litspark.plans.catalog import register
from litspark.plans.q_filters import _long_scores, _long_scores_sql
from litspark.plans.q_terms import cleaned_docs
from litspark.plans.q_vectors import EMB_LONG_SQL
from litspark.sources.tables import Tables


@register("win1_k_nearest_to_median", """
WITH st AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type)
SELECT event_id, event_type, CAST(rank AS INTEGER) AS rank FROM (
  SELECT e.event_id, e.event_type, row_number() OVER (PARTITION BY e.event_type ORDER BY round(abs(e.value - st.median), 9), e.event_id) AS rank
  FROM events e JOIN st USING (event_type)) WHERE rank <= 10""")
def win1(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("event_id", "event_type", "value")
    med = ag.exact_percentiles(e, "value", ["event_type"], [0.5]).select("event_type", F.col("value").alias("median"))
    out = wn.nearest_k(e.join(med, "event_type"), F.col("value"), F.col("median"), ["event_type"], 10, "event_id")
    return out.select("event_id", "event_type", "rank")


POSITIONS = [("2below", -2.0), ("1below", -1.0), ("median", 0.0), ("1above", 1.0), ("2above", 2.0)]


def _positions_sql():
    return "pos AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {m})" for n, m in POSITIONS) + ") v(position, mult))"


WIN2_SQL = "WITH " + EMB_LONG_SQL + """,
c AS (SELECT label AS centroid, dim, avg(v) AS cv FROM el GROUP BY label, dim),
cn AS (SELECT centroid, sqrt(sum(cv * cv)) AS nc FROM c GROUP BY centroid),
en AS (SELECT vec_id, sqrt(sum(v * v)) AS ne FROM el GROUP BY vec_id),
d AS (SELECT el.vec_id, c.centroid, sum(el.v * c.cv) AS dot FROM el JOIN c USING (dim) GROUP BY el.vec_id, c.centroid),
dist AS (SELECT vec_id, centroid, 1.0 - dot / (ne * nc) AS distance FROM d JOIN en USING (vec_id) JOIN cn USING (centroid)),
st AS (SELECT centroid, quantile_cont(distance, 0.5) AS median, stddev_pop(distance) AS std FROM dist GROUP BY centroid),
""" + _positions_sql() + """,
near AS (SELECT * FROM (
  SELECT dist.vec_id, dist.centroid, pos.position, dist.distance,
         row_number() OVER (PARTITION BY dist.centroid, pos.position
                            ORDER BY round(abs(dist.distance - (st.median + pos.mult * st.std)), 9), dist.vec_id) AS rank
  FROM dist JOIN st USING (centroid), pos) WHERE rank <= 10)
"""


def win2_near(spark, sf_dir):
    """10 rows nearest to median + m * std of each centroid's distances, m in -2..2."""
    from litspark.operators import vectors as vx
    from litspark.plans.q_vectors import centroids
    t = Tables(spark, sf_dir)
    c = centroids(t).select(F.col("label").alias("centroid"), F.col("mean_vector"))
    from litspark.session import reuse
    d = reuse(vx.distances_to_references(t.embeddings.select("vec_id", "embedding"), "embedding", c, "centroid",
                                         "mean_vector", "cosine").select("vec_id", "centroid", "distance"))
    med = ag.exact_percentiles(d, "distance", ["centroid"], [0.5]).select("centroid", F.col("value").alias("median"))
    sd = d.groupBy("centroid").agg(F.stddev_pop("distance").alias("std"))
    pos = F.explode(F.array(*[F.struct(F.lit(n).alias("position"), F.lit(m).alias("mult")) for n, m in POSITIONS]))
    x = d.join(med, "centroid").join(sd, "centroid").withColumn("p", pos).select(
        "vec_id", "centroid", "distance", "p.position", (F.col("median") + F.col("p.mult") * F.col("std")).alias("target"))
    return wn.nearest_k(x, F.col("distance"), F.col("target"), ["centroid", "position"], 10, "vec_id")


@register("win2_nearest_at_positions", WIN2_SQL + """
SELECT vec_id, centroid, position, CAST(rank AS INTEGER) AS rank FROM near""")
def win2(spark, sf_dir):
    return win2_near(spark, sf_dir).select("vec_id", "centroid", "position", "rank")


QUART_SQL = """q AS (SELECT primary_subject, perspective, quantile_cont(p_yes, 0.25) AS q25, quantile_cont(p_yes, 0.75) AS q75
                FROM src GROUP BY ALL)"""


def _slices(t: Tables):
    src = _long_scores(t, ("cult", "relt")).join(t.articles.select("doc_id", "primary_subject"), "doc_id")
    q = ag.exact_percentiles(src, "p_yes", ["primary_subject", "perspective"], [0.25, 0.75]) \
        .groupBy("primary_subject", "perspective").pivot("p", [0.25, 0.75]).agg(F.first("value"))
    q = q.toDF("primary_subject", "perspective", "q25", "q75")
    j = src.join(q, ["primary_subject", "perspective"])
    sl = F.when(F.col("p_yes") < F.col("q25"), "low").when(F.col("p_yes") > F.col("q75"), "high")
    return j.withColumn("slice", sl).where(F.col("slice").isNotNull())


SLICES_SQL = S.with_(S.ARTICLES, S.SCORES, _long_scores_sql(("cult", "relt")),
                     "src AS (SELECT * FROM long JOIN articles USING (doc_id))", QUART_SQL) + """,
sl AS (SELECT src.doc_id, src.primary_subject, src.perspective,
        CASE WHEN p_yes < q25 THEN 'low' WHEN p_yes > q75 THEN 'high' END AS slice
       FROM src JOIN q USING (primary_subject, perspective))
"""


@register("win3_quartile_slices", SLICES_SQL + "SELECT doc_id, primary_subject, perspective, slice FROM sl WHERE slice IS NOT NULL")
def win3(spark, sf_dir):
    return _slices(Tables(spark, sf_dir)).select("doc_id", "primary_subject", "perspective", "slice")


@register("win4_positional_slices", SLICES_SQL + """
SELECT doc_id, primary_subject, perspective, slice, CAST(position AS BIGINT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY primary_subject, perspective, slice ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS position
  FROM sl WHERE slice IS NOT NULL)
WHERE (slice = 'low' AND position >= 100 AND position < 106) OR (slice = 'high' AND position >= 100 AND position < 294)""")
def win4(spark, sf_dir):
    s = _slices(Tables(spark, sf_dir))
    r = sm.shuffle_rank(s, "doc_id", 7, ["primary_subject", "perspective", "slice"], name="_pos")
    r = r.withColumn("position", F.col("_pos") - 1)
    keep = ((F.col("slice") == "low") & F.col("position").between(100, 105)) | \
           ((F.col("slice") == "high") & F.col("position").between(100, 293))
    return r.where(keep).select("doc_id", "primary_subject", "perspective", "slice", "position")


@register("win4_slices_by_length", """
SELECT doc_id, lang, CAST(position AS BIGINT) AS position FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS position FROM documents)
WHERE position >= 5 AND position < 25""")
def win4_by_length(spark, sf_dir):
    """Positions 5 to 24 of each language's documents, longest first."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang", "n_chars")
    return wn.positional_slice(d, [F.col("n_chars").desc(), F.col("doc_id")], 5, 25, ["lang"]).select("doc_id", "lang", "position")


@register("win5_daily_quota", """
WITH d AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, md5('5:' || CAST(event_id AS VARCHAR)) AS h FROM events),
per_day AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, event_type ORDER BY h, event_id) AS r FROM d) WHERE r <= 5)
SELECT event_id, event_type, CAST(day AS VARCHAR) AS day FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day, h, event_id) AS q FROM per_day)
WHERE q <= CASE WHEN event_type = 'purchase' THEN 135 ELSE 15 END""")
def win5(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("event_id", "event_type", F.to_date("ts").alias("day"))
    per_day = sm.first_n_by_hash(e, 5, "event_id", 5, ["day", "event_type"])
    # global quota per label (150 rows, 90% for the label of interest), earliest days first
    ranked = sm.global_rank(per_day, [F.col("day"), sm.hash_str(5, F.col("event_id")), F.col("event_id")],
                            ["event_type"], name="q")
    quota = F.when(F.col("event_type") == "purchase", F.lit(135)).otherwise(F.lit(15))
    return ranked.where(F.col("q") <= quota).select("event_id", "event_type", F.col("day").cast("string").alias("day"))


@register("win6_multi_key_sort", S.with_(S.ARTICLES) + """
SELECT doc_id, journal_title, publication_year FROM articles ORDER BY journal_title, publication_year DESC, doc_id""")
def win6(spark, sf_dir):
    a = Tables(spark, sf_dir).articles
    return a.select("doc_id", "journal_title", "publication_year").orderBy(
        "journal_title", F.desc("publication_year"), "doc_id")


@register("win7_preview_limit", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def win7(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@register("set1_2_union_label_sets", """
SELECT doc_id, 'cult' AS perspective, CAST(quality AS DOUBLE) AS score, NULL::VARCHAR AS note FROM labels
UNION ALL SELECT doc_id, 'relt', CAST(toxic AS DOUBLE), NULL FROM labels""")
def set1_2(spark, sf_dir):
    l = Tables(spark, sf_dir).labels
    a = l.select("doc_id", F.lit("cult").alias("perspective"), F.col("quality").cast("double").alias("score"),
                 F.lit(None).cast("string").alias("note"), F.lit(1).alias("only_in_a"))
    b = l.select("doc_id", F.lit("relt").alias("perspective"), F.col("toxic").cast("double").alias("score"),
                 F.lit(None).cast("string").alias("note"))
    common = [c for c in a.columns if c in b.columns]  # concat keeping only shared columns
    return a.select(common).unionByName(b.select(common))


@register("set3_union_distinct", """
SELECT DISTINCT lang, source FROM (SELECT lang, source FROM documents UNION ALL SELECT lang, source FROM documents)""")
def set3(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("lang", "source")
    return d.unionByName(d).distinct()


@register("set3_union_of_label_sets", """
SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1""")
def set3_sets(spark, sf_dir):
    """Two overlapping sets of coded documents, each document once."""
    l = Tables(spark, sf_dir).labels
    return l.where("quality = 1").select("doc_id").unionByName(l.where("toxic = 1").select("doc_id")).distinct()


# The coded sets and the perspective that each was coded for.
CODED_SETS = {"cult": "quality = 1", "relt": "toxic = 1", "demog": "quality = 1 AND toxic = 1"}


@register("set6_coded_sets", " UNION ALL ".join(
    f"SELECT doc_id, '{p}' AS coded_set, " + ", ".join(f"{'1.0::DOUBLE' if o == p else 'NULL::DOUBLE'} AS {o}_score" for o in CODED_SETS)
    + f" FROM labels WHERE {cond}" for p, cond in CODED_SETS.items()))
def set6_coded(spark, sf_dir):
    """Each set with its own perspective's score 1 and nulls for the others,
    which it was not coded for; a document in two sets has two rows."""
    l = Tables(spark, sf_dir).labels
    return ag.coded_sets({p: l.where(cond).select("doc_id") for p, cond in CODED_SETS.items()})


def _top50(t: Tables):
    # labels meet documents, not tokens
    per = cleaned_docs(t).join(t.labels.select("doc_id", F.col("quality").cast("string").alias("class")), "doc_id") \
        .select("class", F.explode(tx.flatten_tokens("doc")).alias("term")).groupBy("class", "term").agg(F.count(F.lit(1)).alias("n"))
    return wn.top_k(per, ["class"], F.col("n"), 50, [F.col("term").asc()])


@register("set4_shared_and_distinct_terms", "WITH " + S.CLEAN_TOKENS + """,
c AS (SELECT CAST(l.quality AS VARCHAR) AS class, term, count(*) AS n FROM ctok JOIN labels l USING (doc_id) GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, term) AS r FROM c) WHERE r <= 50),
shared AS (SELECT term FROM t WHERE class = '0' INTERSECT SELECT term FROM t WHERE class = '1')
SELECT 'shared' AS list, term FROM shared
UNION ALL SELECT 'only_' || class, term FROM t ANTI JOIN shared USING (term)""")
def set4(spark, sf_dir):
    top = _top50(Tables(spark, sf_dir)).select("class", "term")
    shared = top.where(F.col("class") == "0").select("term").intersect(top.where(F.col("class") == "1").select("term"))
    only = top.join(shared, "term", "left_anti").select(F.concat(F.lit("only_"), F.col("class")).alias("list"), "term")
    return shared.select(F.lit("shared").alias("list"), "term").unionByName(only)


@register("set5_6_long_form_provenance", S.with_(S.CODED) + """
SELECT doc_id, perspective, score FROM coded
UNPIVOT (score FOR perspective IN (cultural_score, relational_score)) WHERE score IS NOT NULL""")
def set5_6(spark, sf_dir):
    c = Tables(spark, sf_dir).coded
    u = c.unpivot("doc_id", ["cultural_score", "relational_score"], "perspective", "score")
    return u.where(F.col("score").isNotNull())
