"""Term weighting and phrases on long token tables (TXT1-TXT7, STR29).

A token table is ``(doc_id, [sent_pos, tok_pos,] term)``. Per-document term
frequencies come from one aggregation whose map-side partial aggregate already
sees each whole document (a document never spans partitions), so the shuffle
carries one row per distinct (doc, term). Corpus-level statistics are partial
aggregates too; the only table ever broadcast is a vocabulary whose size is
bounded by ``max_features``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark.functions import text as tx
from litspark.operators import spans


def term_frequencies(tokens: DataFrame, doc_col: str = "doc_id", term_col: str = "term") -> DataFrame:
    return tokens.groupBy(doc_col, term_col).agg(F.count(F.lit(1)).alias("tf"))


def fit_vocabulary(tf: DataFrame, n_docs: DataFrame | None = None, max_features: int = 100000,
                   min_df: int = 1, max_df: float = 0.8, stop_words: list[str] | None = None,
                   doc_col: str = "doc_id", term_col: str = "term") -> DataFrame:
    """(term, idx, df, idf) with smooth idf ln((1+n)/(1+df)) + 1.

    Terms with df > max_df * n are dropped, then the ``max_features`` most
    frequent terms (corpus count; ties by term) are kept; idx is the term's
    rank in alphabetical order, as in a fitted vectorizer."""
    if stop_words:
        tf = tf.where(~F.col(term_col).isin(stop_words))
    stats = tf.groupBy(term_col).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    if n_docs is None:
        n_docs = tf.agg(F.countDistinct(doc_col).alias("n_docs"))
    stats = stats.withColumn("n_docs", n_docs.scalar())  # one-row scalar subquery
    stats = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))
    from litspark.operators.windows import first_n
    from litspark.session import reuse
    vocab = first_n(stats, max_features, F.col("cf"), F.col(term_col), name="_r").drop("_r")
    # alphabetical index over at most max_features rows (a bound by construction)
    vocab = vocab.withColumn("_pos", F.row_number().over(Window.orderBy(term_col)))
    from litspark.session import small_result
    return small_result(vocab.select(
        term_col, "df",
        (F.col("_pos") - 1).alias("idx"),
        (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"),
    ))


def save_vocabulary(vocab: DataFrame, path: str) -> str:
    """Store a fitted vocabulary or phrase list as Parquet, to score with later."""
    vocab.write.mode("overwrite").parquet(path)
    return path


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def tfidf_weights(tf: DataFrame, vocab: DataFrame, doc_col: str = "doc_id", term_col: str = "term",
                  normalize: bool = True) -> DataFrame:
    """(doc, term, tf, weight); out-of-vocabulary terms dropped; rows L2-normalised.

    ``vocab`` is bounded by max_features, so it is broadcast."""
    w = tf.join(F.broadcast(vocab.select(term_col, "idf", "idx")), term_col).withColumn(
        "raw", F.col("tf") * F.col("idf"))
    if not normalize:
        return w.withColumnRenamed("raw", "weight")
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc_col)))
    return w.withColumn("weight", F.col("raw") / norm).drop("raw")


def distinctive_terms(weights: DataFrame, class_col: str, k: int = 50, term_col: str = "term",
                      digits: int = 6) -> DataFrame:
    """Per class: sum of weights per term (rounded), top ``k`` (ties by term)."""
    from litspark.operators.windows import top_k
    s = weights.groupBy(class_col, term_col).agg(F.round(F.sum("weight"), digits).alias("score"))
    return top_k(s, [class_col], F.col("score"), k, [F.col(term_col).asc()])


# --- phrases (TXT1-TXT3) ------------------------------------------------------

def sentence_pairs(sents: DataFrame, toks: str = "toks", connectors: list[str] | None = None) -> DataFrame:
    """Per sentence row, one row per candidate pair: (i, j) are 1-based
    positions of consecutive non-connector tokens; ``phrase`` joins tokens
    i..j with '_' (connectors in between are kept); of neighbours it is null, as a
    and b tell it (``phrase_of``). The pairs are built inside the sentence, so its
    tokens are not copied to every pair."""
    keys = [c for c in sents.columns if c != toks]
    tk = F.col(toks)
    idx = F.filter(F.transform(tk, lambda w, p: F.when(~w.isin(connectors), p + 1) if connectors else p + 1), lambda p: p.isNotNull())

    def pairs(ix):
        m = F.greatest(F.size(ix) - 1, F.lit(0))

        def one(i, j):
            return F.struct(i.alias("i"), j.alias("j"), F.element_at(tk, i).alias("a"), F.element_at(tk, j).alias("b"),
                            F.when(j > i + 1, F.array_join(F.slice(tk, i, j - i + 1), "_")).alias("phrase"))
        return F.zip_with(F.slice(ix, 1, m), F.slice(ix, 2, m), one)

    return sents.select(*keys, F.inline(tx.let(idx, pairs)))


def phrase_of(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("phrase", F.coalesce("phrase", F.concat_ws("_", "a", "b")))


def _adjacent(tk: Column) -> Column:
    """array<struct<a, b>> of adjacent token pairs, built inside the row."""
    n = F.size(tk)
    m = F.greatest(n - 1, F.lit(1))
    # arrays_zip is a plain (non-lambda) expression: much cheaper than zip_with
    return F.when(n > 1, F.arrays_zip(F.slice(tk, 1, m).alias("a"), F.slice(tk, 2, m).alias("b"))) \
        .otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def learn_phrases(sents: DataFrame, min_count: int = 5, threshold: float = 10.0, toks: str = "toks",
                  connectors: list[str] | None = None) -> DataFrame:
    """(phrase, a, b, count, score) with score = (count - min_count) * N /
    (count(a) * count(b)) > threshold, N = distinct words + distinct phrases.
    Words and pairs are counted in one reading (``spans.counted``); N is a scalar
    subquery."""
    from litspark.session import cut_lineage, small_result
    # only a pair counted more often than min_count can score above a threshold of 0 or more
    stats = cut_lineage(spans.counted(sents, toks, connectors, min_count if threshold >= 0 else 0))
    # a phrase determines its words, so pair rows = distinct phrases
    n_vocab = stats.where(F.col("kind") == spans.DISTINCT).agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    pairs = stats.where(F.col("kind") == spans.SPAN).select(
        F.concat_ws("_", "a", F.nullif("mid", F.lit("")), "b").alias("phrase"), "a", "b", "count")
    # pairs are keyed by their words, and a frequent word is a hot key: AQE
    # broadcasts the word table where it is small, else splits skewed partitions
    uni = stats.where(F.col("kind") == spans.WORD)
    ua = uni.select("a", F.col("count").alias("cnt_a"))
    ub = uni.select(F.col("a").alias("b"), F.col("count").alias("cnt_b"))
    s = pairs.join(ua, "a").join(ub, "b").withColumn(
        "score", (F.col("count") - F.lit(min_count)).cast("double") * n_vocab / (F.col("cnt_a") * F.col("cnt_b")))
    return small_result(s.where(F.col("score") > F.lit(threshold)).select("phrase", "a", "b", "count", "score"))


def keep_known(df: DataFrame, keys: list[str], words: str, vocabulary: DataFrame, word_col: str) -> DataFrame:
    """STR24: ``df`` and ``known``, its words that the vocabulary holds, in their
    order (none: an empty list). ``keys`` name a row; a vocabulary beyond
    BROADCAST_PHRASES words is joined by hash."""
    from litspark.operators.aggregates import join_null_safe
    listed = vocabulary.select(F.col(word_col).alias("_w")).where("_w IS NOT NULL").distinct()
    if listed.count() <= BROADCAST_PHRASES:
        listed = F.broadcast(listed)
    each = df.select(*keys, F.posexplode(words).alias("_p", "_w")).join(listed, "_w", "left_semi")
    per = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_w")))["_w"].alias("known"))  # words of one row
    none = F.array().cast("array<string>")
    return join_null_safe(df, per, keys, "left").withColumn("known", F.coalesce("known", none))


#: Accepted phrases that are sent to every task; more meet the spans in parts.
BROADCAST_PHRASES = 500_000


def apply_phrases(sents: DataFrame, phrases: DataFrame, keys: list[str], toks: str = "toks",
                  connectors: list[str] | None = None) -> DataFrame:
    """Greedy left-to-right, non-overlapping merge of accepted phrases, adds
    ``phrased``. A phrase runs from a token to the next one that is no connector
    (no connectors: its neighbour) and is joined with '_', connectors included.

    The spans of a batch of sentences are looked up at once and merged where they
    stand; no sentence is shuffled while the phrases fit a broadcast. ``keys``
    name a sentence; rows of equal keys are merged each on its own."""
    accepted = phrases.select("phrase").where("phrase IS NOT NULL").distinct()
    if accepted.count() <= BROADCAST_PHRASES:
        return spans.merged(sents, toks, connectors, accepted.toArrow()["phrase"].combine_chunks())
    return spans.merged_by_parts(sents, toks, connectors, accepted)


# --- token ids (STR29); dictionary terms are in operators/dictionary.py ---------------

def token_ids(docs: DataFrame, doc_col: str, vocab: DataFrame, pad: int, length: int = 500,
              key: str = "doc_id") -> DataFrame:
    """Vocabulary index per word, UNK = pad + 2 for unknown words, pad + 1 after
    every sentence, first ``length`` ids, padded with ``pad``. Each document is
    cut to ``length`` items inside its row before anything is exploded."""
    period = "<PERIOD>"
    seq = F.slice(F.flatten(F.transform(doc_col, lambda s: F.concat(s, F.array(F.lit(period))))), 1, length)
    ex = docs.select(key, F.posexplode_outer(seq).alias("p", "term"))  # empty documents stay: all padding
    j = ex.join(vocab.select("term", "vec_id"), "term", "left")
    idc = F.when(F.col("term") == period, F.lit(pad + 1)).otherwise(F.coalesce("vec_id", F.lit(pad + 2)))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", idc.cast("long").alias("id")))).alias("_s"))
    ids = F.transform(F.filter("_s", lambda s: s["p"].isNotNull()), lambda s: s["id"])
    padded = F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))
    return g.select(key, padded.alias("ids"))
