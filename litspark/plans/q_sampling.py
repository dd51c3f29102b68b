"""Registered queries: seeded samples, quotas, resampling, splits and folds (SMP*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.operators import filters as fl
from litspark.operators import sampling as sm
from litspark.plans import sqlfrag as S
from litspark.plans.catalog import register
from litspark.plans.q_windows import WIN2_SQL, win2_near
from litspark.sources.tables import Tables


def H(seed, key):
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


def H13(seed, key):
    """First 13 hex digits of the order hash as an integer (same as hash_int)."""
    return f"CAST(('0x' || substr({H(seed, key)}, 1, 13)) AS BIGINT)"


@register("smp1_seeded_sample", f"SELECT doc_id FROM documents ORDER BY {H(43, 'doc_id')}, doc_id LIMIT 30")
def smp1(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id")
    return sm.first_n_by_hash(d, 30, "doc_id", 43)


@register("smp2_shuffle_rank", f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY {H(1, 'doc_id')}, doc_id) AS BIGINT) AS rank FROM documents""")
def smp2(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id")
    return sm.shuffle_rank(d, "doc_id", 1).select("doc_id", "rank")


@register("smp3_stratified_equal", S.with_(S.ARTICLES) + f""",
m AS (SELECT least(50, min(c)) AS m FROM (SELECT count(*) AS c FROM articles GROUP BY primary_subject)),
per AS (SELECT doc_id, primary_subject FROM (
  SELECT doc_id, primary_subject, row_number() OVER (PARTITION BY primary_subject ORDER BY {H(43, 'doc_id')}, doc_id) AS r
  FROM articles) WHERE r <= (SELECT m FROM m))
SELECT doc_id, primary_subject FROM per ORDER BY {H(44, 'doc_id')}, doc_id LIMIT 50""")
def smp3(spark, sf_dir):
    a = Tables(spark, sf_dir).articles.select("doc_id", "primary_subject")
    return sm.stratified_equal(a, "primary_subject", 50, "doc_id", 43, 44)


POOLS = [("minority", 0.4), ("majority", 0.2), ("fuzzy", 0.4)]
SAMPLE_SIZE = 50


def _pools(t: Tables):
    s = t.scores.join(t.articles.select("doc_id", "primary_subject", "journal_title"), "doc_id")
    p = F.col("prediction_cult_prob_yes")
    return {"minority": s.where(p > 0.8), "majority": s.where(p < 0.3),
            "fuzzy": s.where(fl.fuzzy_prediction(p))}


def _pools_sql():
    p = "prediction_cult_prob_yes"
    return f"""pools AS (
  SELECT 'minority' AS pool, doc_id, primary_subject, journal_title FROM scores JOIN articles USING (doc_id) WHERE {p} > 0.8
  UNION ALL SELECT 'majority', doc_id, primary_subject, journal_title FROM scores JOIN articles USING (doc_id) WHERE {p} < 0.3
  UNION ALL SELECT 'fuzzy', doc_id, primary_subject, journal_title FROM scores JOIN articles USING (doc_id)
    WHERE abs(2.0 * {p} - 1.0) BETWEEN 0.1 AND 0.5)"""


STRATIFY = ["primary_subject", "journal_title"]


def _smp4_sql():
    parts = []
    for pool, prop in POOLS:
        for col in STRATIFY:
            want = int(prop * SAMPLE_SIZE) // len(STRATIFY)
            parts.append(f"""SELECT * FROM (
  SELECT '{pool}' AS pool, '{col}' AS stratum, doc_id FROM (
    SELECT *, row_number() OVER (PARTITION BY {col} ORDER BY {H(43, 'doc_id')}, doc_id) AS r FROM pools
    WHERE pool = '{pool}')
  WHERE r <= (SELECT least({want}, min(c)) FROM (SELECT count(*) AS c FROM pools WHERE pool = '{pool}' GROUP BY {col}))
  ORDER BY {H(44, 'doc_id')}, doc_id LIMIT {want})""")
    return "\nUNION ALL\n".join(parts)


@register("smp4_composed_sample", S.with_(S.ARTICLES, S.SCORES, _pools_sql()) + f""",
picked AS ({_smp4_sql()})
SELECT p.pool, p.stratum, p.doc_id, a.journal_title FROM picked p JOIN articles a USING (doc_id)""")
def smp4(spark, sf_dir):
    """Quotas int(p * size) / 2 from the minority, majority and fuzzy pools for
    each of two stratify columns; rows fetched by key, duplicates kept."""
    t = Tables(spark, sf_dir)
    pools = _pools(t)
    out = sm.composed_sample([(name, pools[name], share) for name, share in POOLS], STRATIFY, SAMPLE_SIZE, "doc_id", 43, 44)
    return out.join(t.articles.select("doc_id", "journal_title"), "doc_id").select("pool", "stratum", "doc_id", "journal_title")


@register("smp5_class_quota", S.with_(S.SCORES) + f"""
SELECT doc_id, prediction_cult AS class, CAST(row_number() OVER (ORDER BY {H(9, 'doc_id')}, doc_id) AS BIGINT) AS shuffle_rank FROM (
  SELECT doc_id, prediction_cult, row_number() OVER (PARTITION BY prediction_cult ORDER BY {H(8, 'doc_id')}, doc_id) AS r
  FROM scores) WHERE r <= 60""")
def smp5(spark, sf_dir):
    s = Tables(spark, sf_dir).scores.select("doc_id", F.col("prediction_cult").alias("class"))
    picked = sm.first_n_by_hash(s, int(150 * 0.4), "doc_id", 8, ["class"])
    return sm.shuffle_rank(picked, "doc_id", 9, name="shuffle_rank").select("doc_id", "class", "shuffle_rank")


QUOTAS = {"2above": 2, "1above": 3, "median": 5, "1below": 3, "2below": 2}


@register("smp6_position_quota", WIN2_SQL + """,
quota AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', {v})" for k, v in QUOTAS.items()) + """) v(position, q))
SELECT vec_id, centroid, near.position FROM near JOIN quota USING (position) WHERE rank <= q""")
def smp6(spark, sf_dir):
    n = win2_near(spark, sf_dir)
    q = spark.createDataFrame(list(QUOTAS.items()), "position string, q int")
    return n.join(F.broadcast(q), "position").where(F.col("rank") <= F.col("q")).select("vec_id", "centroid", "position")


@register("smp7_band_samples", f"""
WITH st AS (SELECT event_type, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS std FROM events GROUP BY event_type),
b AS (SELECT e.event_id, e.event_type, CASE WHEN e.value > median - std AND e.value < median THEN 'below'
        WHEN e.value > median AND e.value < median + std THEN 'above' END AS band FROM events e JOIN st USING (event_type))
SELECT event_id, event_type, band FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, band ORDER BY {H(11, 'event_id')}, event_id) AS r FROM b
  WHERE band IS NOT NULL) WHERE r <= 5""")
def smp7(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("event_id", "event_type", "value")
    b = fl.band_around_median(e, "value", ["event_type"]).select("event_id", "event_type", "band")
    return sm.first_n_by_hash(b, 5, "event_id", 11, ["event_type", "band"])


def _counts_sql():
    return "cnt AS (SELECT count(*) FILTER (WHERE quality = 0) AS n_min, count(*) FILTER (WHERE quality = 1) AS n_maj FROM labels)"


@register("smp8_oversample_minority", f"""
WITH {_counts_sql()},
mino AS (SELECT doc_id, quality, row_number() OVER (ORDER BY {H(3, 'doc_id')}, doc_id) AS pos FROM labels WHERE quality = 0),
draws AS (SELECT i AS draw, CAST(('0x' || substr({H(3, 'i')}, 1, 8)) AS BIGINT) % (SELECT n_min FROM cnt) + 1 AS pos
          FROM range(0, (SELECT n_maj - n_min FROM cnt)) r(i))
SELECT doc_id, quality, CAST(-1 AS BIGINT) AS draw FROM labels
UNION ALL SELECT m.doc_id, m.quality, d.draw FROM draws d JOIN mino m USING (pos)""")
def smp8(spark, sf_dir):
    l = Tables(spark, sf_dir).labels.select("doc_id", "quality")
    return sm.oversample(l, "quality", 0, 1.0, "doc_id", 3).select("doc_id", "quality", "draw")


@register("smp9_undersample_majority", f"""
WITH {_counts_sql()}
SELECT doc_id, quality FROM labels WHERE quality <> 1
UNION ALL SELECT doc_id, quality FROM (
  SELECT doc_id, quality, row_number() OVER (ORDER BY {H(4, 'doc_id')}, doc_id) AS r FROM labels WHERE quality = 1)
WHERE r <= (SELECT n_min FROM cnt)""")
def smp9(spark, sf_dir):
    l = Tables(spark, sf_dir).labels.select("doc_id", "quality")
    return sm.undersample(l, "quality", 1, 1.0, "doc_id", 4)


def _split_sql(seed, p=0.2):
    return (f"CASE WHEN row_number() OVER (ORDER BY {H(seed, 'doc_id')}, doc_id) <= ceil({p} * count(*) OVER ()) "
            f"THEN 'validation' ELSE 'train' END")


@register("smp11_train_validation_split", f"SELECT doc_id, {_split_sql(42)} AS split FROM labels")
def smp11(spark, sf_dir):
    l = Tables(spark, sf_dir).labels.select("doc_id")
    return sm.split_train_validation(l, 0.2, "doc_id", 42).select("doc_id", "split")


@register("smp12_kfold_assignment", f"""
SELECT doc_id, CAST((row_number() OVER (ORDER BY {H(5, 'doc_id')}, doc_id) - 1) % 10 AS INTEGER) AS fold,
       CAST((row_number() OVER (PARTITION BY quality ORDER BY {H(5, 'doc_id')}, doc_id) - 1) % 10 AS INTEGER) AS strat_fold
FROM labels""")
def smp12(spark, sf_dir):
    l = Tables(spark, sf_dir).labels.select("doc_id", "quality")
    a = sm.kfold(l, 10, "doc_id", 5, name="fold")
    b = sm.kfold(l, 10, "doc_id", 5, stratify="quality", name="strat_fold").select("doc_id", "strat_fold")
    return a.join(b, "doc_id").select("doc_id", "fold", "strat_fold")


SEEDS = [11, 22, 33, 44, 55]


@register("smp13_repeated_holdout", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {s} AS seed, doc_id, {_split_sql(s)} AS split FROM labels" for s in SEEDS) + ")")
def smp13(spark, sf_dir):
    l = Tables(spark, sf_dir).labels.select("doc_id")
    # one hold-out per drawn seed, ranked in one pass
    each = l.withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    order = F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("doc_id").cast("string")))
    r = sm.global_rank(each, [order, F.col("doc_id")], ["seed"], "_pos")
    k = F.ceil(F.lit(0.2) * l.agg(F.count(F.lit(1))).scalar())
    return r.select("seed", "doc_id", F.when(F.col("_pos") <= k, F.lit("validation")).otherwise(F.lit("train")).alias("split"))


@register("smp14_split_then_oversample", f"""
WITH sp AS (SELECT doc_id, quality, {_split_sql(42)} AS split FROM labels),
cnt AS (SELECT split, count(*) FILTER (WHERE quality = 0) AS n_min, count(*) FILTER (WHERE quality = 1) AS n_maj FROM sp GROUP BY split)
SELECT split, quality, CAST(n AS BIGINT) AS n FROM (
  SELECT split, quality, count(*) AS n FROM sp GROUP BY ALL
  UNION ALL SELECT split, 0, n_maj - n_min FROM cnt WHERE n_maj > n_min)
""".replace("SELECT split, quality, CAST(n AS BIGINT) AS n FROM (", "SELECT split, quality, CAST(sum(n) AS BIGINT) AS n FROM (") + " GROUP BY split, quality")
def smp14(spark, sf_dir):
    l = Tables(spark, sf_dir).labels.select("doc_id", "quality")
    sp = sm.split_train_validation(l, 0.2, "doc_id", 42)
    out = None
    for part in ("train", "validation"):  # resample each part on its own: no leakage
        o = sm.oversample(sp.where(F.col("split") == part), "quality", 0, 1.0, "doc_id", 3)
        out = o if out is None else out.unionByName(o)
    return out.groupBy("split", "quality").agg(F.count(F.lit(1)).alias("n"))


# SMP10: SMOTE ------------------------------------------------------------------
SMOTE_K = 5


@register("smp10_smote", "WITH " + """el AS (SELECT vec_id, label, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS dim,
       CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
cnt AS (SELECT count(*) FILTER (WHERE label = 0) AS n_min, count(*) FILTER (WHERE label <> 0) AS n_maj FROM embeddings),
mino AS (SELECT vec_id, row_number() OVER (ORDER BY """ + H(6, "vec_id") + """, vec_id) AS pos FROM embeddings WHERE label = 0),
me AS (SELECT * FROM el WHERE label = 0),
dd AS (SELECT a.vec_id, b.vec_id AS nb, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM me a JOIN me b USING (dim)
       WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
nn AS (SELECT vec_id, nb, row_number() OVER (PARTITION BY vec_id ORDER BY d, nb) AS j FROM dd),
draws AS (SELECT i AS synth_id,
            CAST(('0x' || substr(""" + H(6, "i") + """, 1, 8)) AS BIGINT) % (SELECT n_min FROM cnt) + 1 AS pos,
            CAST(('0x' || substr(""" + H(6, "i") + """, 9, 8)) AS BIGINT) % """ + str(SMOTE_K) + """ + 1 AS j,
            CAST(('0x' || substr(""" + H(6, "i") + """, 17, 13)) AS BIGINT) / 4503599627370496.0 AS w
          FROM range(0, (SELECT n_maj - n_min FROM cnt)) r(i)),
pick AS (SELECT d.synth_id, m.vec_id AS base, nn.nb, d.w FROM draws d JOIN mino m USING (pos) JOIN nn ON nn.vec_id = m.vec_id AND nn.j = d.j)
SELECT p.synth_id, a.dim, round(a.v + p.w * (b.v - a.v), 6) AS value
FROM pick p JOIN el a ON a.vec_id = p.base JOIN el b ON b.vec_id = p.nb AND b.dim = a.dim""")
def smp10(spark, sf_dir):
    """SMOTE for label 0 against the rest (ratio 1.0)."""
    e = Tables(spark, sf_dir).embeddings.withColumn("minority", (F.col("label") == 0).cast("int"))
    out = sm.smote(e, "minority", 1, 1.0, "vec_id", "embedding", SMOTE_K, 6).select("synth_id", F.posexplode("vector").alias("dim", "value"))
    return out.select("synth_id", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))
