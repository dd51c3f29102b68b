"""Registered queries: term weighting, phrases, token ids (TXT*, STR28-29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.functions import lexicon
from litspark.functions import text as tx
from litspark.operators import dictionary, spans, terms
from litspark.plans import sqlfrag as S
from litspark.plans.catalog import register
from litspark.sources.dictionaries import dictionary_table, multiword_terms
from litspark.session import cut_lineage, reuse
from litspark.sources.tables import Tables


def cleaned_once(t: Tables, stop_words: bool = True):
    """(doc_id, doc) with the cleaned sentence arrays. The texts are dealt out by
    doc_id before they are cleaned: a file with few row groups is read by few
    tasks, cleaning is the longest step, and texts are smaller than token arrays.
    Term frequencies and the norm per document then need no exchange of their own."""
    texts = t.documents.select("doc_id", "text").repartition("doc_id")
    return texts.select("doc_id", tx.clean_document("text", remove_stopwords=stop_words).alias("doc"))


def cleaned_docs(t: Tables):
    """The cleaned documents, kept for queries that read them more than once."""
    return reuse(cleaned_once(t))


def tokens_of(docs):
    return docs.select("doc_id", F.explode(tx.flatten_tokens("doc")).alias("term"))


def clean_tokens(t: Tables):
    """(doc_id, term) stream of the fully cleaned corpus, for one reading."""
    return tokens_of(cleaned_once(t))


def corpus_tfidf(t: Tables, max_features: int = 100000, max_df: float = 0.8):
    tf = reuse(terms.term_frequencies(clean_tokens(t)))  # read by the vocabulary fit and the weighting
    n_docs = t.documents.agg(F.count(F.lit(1)).alias("n_docs"))
    vocab = terms.fit_vocabulary(tf, n_docs, max_features=max_features, max_df=max_df)
    return tf, vocab, terms.tfidf_weights(tf, vocab)


TFIDF_SQL = S.CLEAN_TOKENS + """,
tf AS (SELECT doc_id, term, count(*) AS tf FROM ctok GROUP BY ALL),
nd AS (SELECT count(*) AS n_docs FROM documents),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
vocab AS (SELECT term, df, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf,
                 row_number() OVER (ORDER BY term) - 1 AS idx
          FROM (SELECT * FROM st, nd WHERE df >= 1 AND df <= 0.8 * n_docs ORDER BY cf DESC, term LIMIT 100000)),
w AS (SELECT doc_id, term, tf, idx, tf * idf AS raw FROM tf JOIN vocab USING (term)),
wn AS (SELECT doc_id, term, tf, idx, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


def distinctive_terms(spark, sf_dir):
    """Flagship: clean every document, fit TF-IDF on the corpus, and list the
    50 terms with the largest summed weight in each label class (TXT4+TXT6)."""
    t = Tables(spark, sf_dir)
    tf, vocab, _ = corpus_tfidf(t)
    # the vocabulary is fitted on the whole corpus; weights (and their per-document
    # normalisation) are only needed for the labelled documents
    tl = tf.join(t.labels.select("doc_id", "quality"), "doc_id")
    top = terms.distinctive_terms(terms.tfidf_weights(tl, vocab), "quality", k=50)
    return top.select("quality", "term", "score", F.col("rank").cast("int").alias("rank"))


register("txt6_distinctive_terms", "WITH " + TFIDF_SQL + """,
s AS (SELECT l.quality, term, round(sum(weight), 6) AS score FROM wn JOIN labels l USING (doc_id) GROUP BY ALL)
SELECT quality, term, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 50
""")(distinctive_terms)


# --- phrases ---------------------------------------------------------------------

def clean_sents(t: Tables, stop_words: bool = True, packed: bool = False):
    """(doc_id, sent_pos, toks): cleaned sentences. The document-level arrays
    are kept; exploding them again per use is cheap. ``packed``: the sentences are
    written to the checkpoint folder, words numbered and compressed, at about a
    tenth of the arrays' bytes; each reading unpacks them in Python."""
    if packed:
        # of an outer generator no filter on the cleaned document is inferred, which would clean twice
        sents = cleaned_once(t, stop_words).select("doc_id", F.posexplode_outer("doc").alias("sent_pos", "toks")).where("sent_pos IS NOT NULL")
        return spans.unpacked(cut_lineage(spans.packed(sents)), sents.schema)
    d = reuse(cleaned_once(t, stop_words))
    return d.select("doc_id", F.posexplode("doc").alias("sent_pos", "toks"))


def _sents_sql(stop_words: bool = True, name: str = "cs"):
    return f"""{name} AS (SELECT doc_id, CAST(unnest(generate_series(0, len(doc) - 1)) AS INTEGER) AS sent_pos, unnest(doc) AS toks
  FROM (SELECT doc_id, {S.clean_document('text', stop_words)} AS doc FROM documents))"""


def _phrase_sql(connectors: bool, min_count=5, threshold=10.0):
    conn = S.lst(lexicon.ARCHIVE_STOP_WORDS)
    keep = f"lambda i: NOT list_contains({conn}, toks[i])" if connectors else "lambda i: true"
    return f""",
idx AS (SELECT doc_id, sent_pos, toks, list_filter(generate_series(1, len(toks)), {keep}) AS ix FROM cs),
pr AS (SELECT toks[ix[k]] AS a, toks[ix[k + 1]] AS b, array_to_string(toks[ix[k]:ix[k + 1]], '_') AS phrase
       FROM (SELECT toks, ix, unnest(generate_series(1, len(ix) - 1)) AS k FROM idx WHERE len(ix) > 1)),
uni AS (SELECT w, count(*) AS cnt FROM (SELECT unnest(toks) AS w FROM cs) GROUP BY w),
pc AS (SELECT phrase, a, b, count(*) AS count FROM pr GROUP BY ALL),
nv AS (SELECT (SELECT count(*) FROM uni) + (SELECT count(DISTINCT phrase) FROM pc) AS n),
ph AS (SELECT phrase, a, b, count, (count - {min_count}) * (SELECT n FROM nv) / (ua.cnt * ub.cnt) AS score
       FROM pc JOIN uni ua ON ua.w = pc.a JOIN uni ub ON ub.w = pc.b)
"""


@register("txt1_phrase_detection", "WITH " + _sents_sql() + _phrase_sql(False) + """
SELECT phrase, CAST(count AS BIGINT) AS count, round(score, 6) AS score FROM ph WHERE score > 10.0""")
def txt1(spark, sf_dir):
    ph = terms.learn_phrases(clean_sents(Tables(spark, sf_dir), packed=True), 5, 10.0)
    return ph.select("phrase", "count", F.round("score", 6).alias("score"))


@register("txt2_phrases_across_connectors", "WITH " + _sents_sql(False) + _phrase_sql(True) + """
SELECT phrase, CAST(count AS BIGINT) AS count, round(score, 6) AS score FROM ph WHERE score > 10.0""")
def txt2(spark, sf_dir):
    ph = terms.learn_phrases(clean_sents(Tables(spark, sf_dir), stop_words=False, packed=True), 5, 10.0,
                             connectors=lexicon.ARCHIVE_STOP_WORDS)
    return ph.select("phrase", "count", F.round("score", 6).alias("score"))


@register("txt3_apply_phrases", "WITH " + _sents_sql() + _phrase_sql(False) + """,
acc AS (SELECT DISTINCT phrase FROM ph WHERE score > 10.0),
cand AS (SELECT doc_id, sent_pos, i FROM (
  SELECT doc_id, sent_pos, i, toks[i] || '_' || toks[i + 1] AS phrase
  FROM (SELECT doc_id, sent_pos, toks, unnest(generate_series(1, len(toks) - 1)) AS i FROM cs WHERE len(toks) > 1))
  SEMI JOIN acc USING (phrase)),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, sent_pos ORDER BY i) AS island FROM cand),
mrg AS (SELECT doc_id, sent_pos, i FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, sent_pos, island ORDER BY i) AS r FROM isl) WHERE r % 2 = 1),
pos AS (SELECT doc_id, sent_pos, toks, unnest(generate_series(1, len(toks))) AS p FROM cs),
out AS (SELECT pos.doc_id, pos.sent_pos, pos.p,
          CASE WHEN m.i IS NOT NULL THEN toks[p] || '_' || toks[p + 1] WHEN m2.i IS NOT NULL THEN NULL ELSE toks[p] END AS w
        FROM pos LEFT JOIN mrg m ON m.doc_id = pos.doc_id AND m.sent_pos = pos.sent_pos AND m.i = pos.p
        LEFT JOIN mrg m2 ON m2.doc_id = pos.doc_id AND m2.sent_pos = pos.sent_pos AND m2.i = pos.p - 1)
SELECT doc_id, sent_pos, string_agg(w, ' ' ORDER BY p) AS phrased FROM out WHERE w IS NOT NULL GROUP BY doc_id, sent_pos""")
def txt3(spark, sf_dir):
    cs = clean_sents(Tables(spark, sf_dir), packed=True)
    ph = terms.learn_phrases(cs, 5, 10.0)
    out = terms.apply_phrases(cs, ph, ["doc_id", "sent_pos"])
    return out.select("doc_id", "sent_pos", F.array_join("phrased", " ").alias("phrased"))


@register("txt3_apply_connector_phrases", "WITH " + _sents_sql(False) + _phrase_sql(True) + """,
acc AS (SELECT DISTINCT phrase FROM ph WHERE score > 10.0),
sp AS (SELECT doc_id, sent_pos, ix[k] AS i, ix[k + 1] AS j, array_to_string(toks[ix[k]:ix[k + 1]], '_') AS phrase, k
       FROM (SELECT doc_id, sent_pos, toks, ix, unnest(generate_series(1, len(ix) - 1)) AS k FROM idx WHERE len(ix) > 1)),
hit AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, sent_pos ORDER BY k) AS island FROM sp SEMI JOIN acc USING (phrase)),
mrg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_pos, island ORDER BY k) AS r FROM hit) WHERE r % 2 = 1),
pos AS (SELECT doc_id, sent_pos, toks, unnest(generate_series(1, len(toks))) AS p FROM cs),
out AS (SELECT pos.doc_id, pos.sent_pos, pos.p, CASE WHEN m.i IS NULL THEN toks[p] WHEN m.i = p THEN m.phrase END AS w
        FROM pos LEFT JOIN mrg m ON m.doc_id = pos.doc_id AND m.sent_pos = pos.sent_pos AND p BETWEEN m.i AND m.j)
SELECT doc_id, sent_pos, string_agg(w, ' ' ORDER BY p) AS phrased FROM out WHERE w IS NOT NULL GROUP BY doc_id, sent_pos""")
def txt3_connectors(spark, sf_dir):
    """Phrases learned across connectors (TXT2), merged in the sentences."""
    cs = clean_sents(Tables(spark, sf_dir), stop_words=False, packed=True)
    conn = lexicon.ARCHIVE_STOP_WORDS
    ph = terms.learn_phrases(cs, 5, 10.0, connectors=conn)
    out = terms.apply_phrases(cs, ph, ["doc_id", "sent_pos"], connectors=conn)
    return out.select("doc_id", "sent_pos", F.array_join("phrased", " ").alias("phrased"))


# --- frozen vocabulary, listing -------------------------------------------------

FROZEN_SQL = S.CLEAN_TOKENS + """,
tf AS (SELECT doc_id, term, count(*) AS tf FROM ctok GROUP BY ALL),
trn AS (SELECT * FROM tf WHERE doc_id IN (SELECT doc_id FROM labels)),
nd AS (SELECT count(*) AS n_docs FROM labels),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM trn GROUP BY term),
vocab AS (SELECT term, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf
          FROM (SELECT * FROM st, nd WHERE df <= 0.8 * n_docs ORDER BY cf DESC, term LIMIT 100000)),
w AS (SELECT doc_id, term, tf * idf AS raw FROM tf JOIN vocab USING (term)),
wn AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@register("txt5_frozen_vocabulary_transform", "WITH " + FROZEN_SQL + """
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, round(max(weight), 6) AS max_weight,
       arg_min(term, (-round(weight, 9), term)) AS top_term
FROM wn GROUP BY doc_id""")
def txt5(spark, sf_dir):
    """Fit on the labelled (training) documents, transform every document with
    the frozen vocabulary: terms outside it are dropped."""
    t = Tables(spark, sf_dir)
    tf = reuse(terms.term_frequencies(clean_tokens(t)))  # read by the vocabulary fit and the weighting
    train = tf.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    vocab = terms.fit_vocabulary(train, t.labels.agg(F.count(F.lit(1)).alias("n")), max_features=100000, max_df=0.8)
    w = terms.tfidf_weights(tf, vocab)
    key = F.struct((-F.round("weight", 9)).alias("k"), F.col("term"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("weight"), 6).alias("max_weight"),
                                   F.min_by("term", key).alias("top_term"))


@register("txt7_vocabulary_listing", "WITH " + TFIDF_SQL + """
SELECT CAST(idx AS BIGINT) AS idx, term FROM vocab WHERE idx % 1000 = 0""")
def txt7(spark, sf_dir):
    _, vocab, _ = corpus_tfidf(Tables(spark, sf_dir))
    return vocab.where(F.col("idx") % 1000 == 0).select(F.col("idx").cast("long").alias("idx"), "term")


# --- STR28-STR29 -------------------------------------------------------------------

def _fix_sql(c):
    for ng in multiword_terms():
        c = f"replace({c}, {S.q(ng)}, {S.q(ng.replace(' ', '_'))})"
    return c


@register("str28_fix_ngrams", "WITH " + _sents_sql() + f"""
SELECT doc_id, sent_pos, fixed FROM (
  SELECT doc_id, sent_pos, array_to_string(string_split_regex(trim({_fix_sql("array_to_string(toks, ' ')")}), '\\s+'), ' ') AS fixed FROM cs)
WHERE contains(fixed, '_')""")
def str28(spark, sf_dir):
    cs = clean_sents(Tables(spark, sf_dir))
    out = dictionary.join_terms(cs, ["doc_id", "sent_pos"], "toks", dictionary_table(spark).select("term"))
    return out.select("doc_id", "sent_pos", F.array_join("fixed", " ").alias("fixed")).where(F.contains("fixed", F.lit("_")))


TOKEN_IDS_LEN = 500


@register("str29_token_ids", "WITH " + S.CLEAN_TOKENS + """,
wv AS (SELECT term, vec_id FROM (SELECT term, row_number() OVER (ORDER BY cnt DESC, term) - 1 AS vec_id
       FROM (SELECT term, count(*) AS cnt FROM ctok GROUP BY term)) JOIN embeddings USING (vec_id)),
nv AS (SELECT count(*) AS pad FROM embeddings),
seq AS (SELECT doc_id, list_slice(flatten(list_transform(doc, lambda s: list_concat(s, ['<PERIOD>']))), 1, """ + str(TOKEN_IDS_LEN) + """) AS sq FROM clean),
ex AS (SELECT doc_id, unnest(sq) AS term, unnest(generate_series(1, len(sq))) AS p FROM seq),
ids AS (SELECT ex.doc_id, ex.p, CASE WHEN ex.term = '<PERIOD>' THEN (SELECT pad FROM nv) + 1
          ELSE coalesce(wv.vec_id, (SELECT pad FROM nv) + 2) END AS id FROM ex LEFT JOIN wv USING (term))
SELECT doc_id, ltrim(coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY p), '') || repeat(',' || CAST((SELECT pad FROM nv) AS VARCHAR),
       """ + str(TOKEN_IDS_LEN) + """ - count(id)), ',') AS token_ids
FROM documents LEFT JOIN ids USING (doc_id) GROUP BY doc_id""")
def str29(spark, sf_dir):
    from litspark.operators.vectors import word_vectors
    t = Tables(spark, sf_dir)
    d = cleaned_docs(t)
    wv = word_vectors(tokens_of(d), t.embeddings).select("term", "vec_id")
    pad = t.embeddings.count()
    ids = terms.token_ids(d, "doc", wv, pad, TOKEN_IDS_LEN)
    return ids.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("token_ids"))


@register("txt4_tfidf_fit", "WITH " + TFIDF_SQL + """
SELECT v.term, CAST(v.idx AS BIGINT) AS idx, CAST(v.df AS BIGINT) AS df, round(v.idf, 6) AS idf,
       round(sum(wn.weight), 6) AS total_weight
FROM vocab v JOIN wn USING (term) GROUP BY v.term, v.idx, v.df, v.idf""")
def txt4(spark, sf_dir):
    """The fitted vocabulary (index, document frequency, smooth idf) with each
    term's summed L2-normalised weight over the corpus."""
    _, vocab, w = corpus_tfidf(Tables(spark, sf_dir))
    tot = w.groupBy("term").agg(F.round(F.sum("weight"), 6).alias("total_weight"))
    return vocab.join(tot, "term").select("term", F.col("idx").cast("long").alias("idx"), F.col("df").cast("long").alias("df"),
                                          F.round("idf", 6).alias("idf"), "total_weight")
