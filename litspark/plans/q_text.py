"""Registered queries: scalar string, id, year and label projections (STR*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.functions import lexicon
from litspark.functions import text as tx
from litspark.functions.ratio import exact_ratio
from litspark.operators import terms
from litspark.plans import sqlfrag as S
from litspark.plans.catalog import register
from litspark.session import reuse
from litspark.sources.tables import Tables

Q = S.q


def _t(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


# STR1 -----------------------------------------------------------------------
@register("str1_strip_scheme", """
SELECT page_id,
  CASE WHEN len(string_split(url, 'http://')) > 1 THEN string_split(url, 'http://')[2] ELSE url END AS url_no_http,
  CASE WHEN len(string_split(url, 'https://')) > 1 THEN string_split(url, 'https://')[2] ELSE url END AS url_no_https
FROM pages""")
def str1(spark, sf_dir):
    p = _t(spark, sf_dir).pages
    return p.select("page_id", tx.strip_scheme("url").alias("url_no_http"),
                    tx.strip_scheme("url", https=True).alias("url_no_https"))


# STR2-STR4 ------------------------------------------------------------------
@register("str2_4_ids_and_paths", S.with_(S.ARTICLES) + """
SELECT doc_id,
  left(string_split(file_name, '-')[-1], greatest(length(string_split(file_name, '-')[-1]) - 4, 0)) AS id_last_part,
  substring(file_name, 17) AS id_slice,
  regexp_replace(file_name, '^journal-article-', '/corpus/ocr/') AS path_rewritten,
  '/corpus/ocr/' || 'journal-article-' || CAST(doc_id AS VARCHAR) || '.txt' AS path_built
FROM articles""")
def str2_4(spark, sf_dir):
    a = _t(spark, sf_dir).articles
    return a.select("doc_id", tx.id_from_filename("file_name").alias("id_last_part"),
                    F.substring("file_name", 17, 1 << 30).alias("id_slice"),
                    F.regexp_replace("file_name", "^journal-article-", "/corpus/ocr/").alias("path_rewritten"),
                    tx.path_for_id("doc_id", "/corpus/ocr/").alias("path_built"))


# STR5-STR6 ------------------------------------------------------------------
@register("str5_citation_title", S.with_(S.citations_cte()) + f"""
SELECT cite_id, {S.normalize_title(S.CITE_TITLE)} AS title
FROM citations""")
def str5(spark, sf_dir):
    c = _t(spark, sf_dir).citations
    return c.select("cite_id", tx.citation_title("citation").alias("title"))


@register("str6_title_normalize", f"SELECT item_id, {S.normalize_title('text')} AS title FROM benchmark")
def str6(spark, sf_dir):
    return _t(spark, sf_dir).benchmark.select("item_id", tx.normalize_title("text").alias("title"))


# STR7 -------------------------------------------------------------------------
YEAR_RAW_SQL = ("CAST(1970 + doc_id % 47 AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '/' || "
                "CAST((1971 + doc_id % 47) % 100 AS VARCHAR) WHEN doc_id % 3 = 1 THEN 'ca.' ELSE '' END")


def _year_raw():
    y = (F.lit(1970) + F.col("doc_id") % 47).cast("string")
    nxt = ((F.lit(1971) + F.col("doc_id") % 47) % 100).cast("string")
    return F.concat(y, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/"), nxt))
                    .when(F.col("doc_id") % 3 == 1, F.lit("ca.")).otherwise(F.lit("")))


@register("str7_year_parse", f"""
SELECT doc_id, year_raw, regexp_replace(year_raw, '\\D+', '', 'g') AS year_digits,
  CAST(coalesce(CASE WHEN regexp_full_match(year_raw, '\\s*[+-]?\\d+\\s*') THEN CAST(trim(year_raw) AS INTEGER) END,
           CASE WHEN regexp_full_match(left(year_raw, 4), '\\s*[+-]?\\d+\\s*') THEN CAST(trim(left(year_raw, 4)) AS INTEGER) END)
       AS INTEGER) AS year_int
FROM (SELECT doc_id, {YEAR_RAW_SQL} AS year_raw FROM documents)""")
def str7(spark, sf_dir):
    d = _t(spark, sf_dir).documents.select("doc_id", _year_raw().alias("year_raw"))
    return d.select("doc_id", "year_raw", tx.digits_only("year_raw").alias("year_digits"),
                    tx.year_int("year_raw").alias("year_int"))


# STR8-STR9 --------------------------------------------------------------------
@register("str8_strip_tags", f"SELECT page_id, {S.strip_tags('html')} AS body FROM pages")
def str8(spark, sf_dir):
    return _t(spark, sf_dir).pages.select("page_id", tx.strip_tags("html").alias("body"))


@register("str9_remove_tags_spaced_opener",
          f"SELECT page_id, {S.strip_tags('html', tx.PAGE_OPENER_SPACED)} AS body FROM pages")
def str9(spark, sf_dir):
    return _t(spark, sf_dir).pages.select("page_id", tx.strip_tags("html", tx.PAGE_OPENER_SPACED).alias("body"))


@register("str9_spaced_opener_removed",
          f"SELECT page_id, {S.strip_tags('html', tx.PAGE_OPENER_SPACED)} AS body FROM (SELECT page_id, {Q(tx.PAGE_OPENER_SPACED)} || html AS html FROM pages)")
def str9_opener(spark, sf_dir):
    """Pages that begin with the spaced opener."""
    p = _t(spark, sf_dir).pages.select("page_id", F.concat(F.lit(tx.PAGE_OPENER_SPACED), "html").alias("html"))
    return p.select("page_id", tx.strip_tags("html", tx.PAGE_OPENER_SPACED).alias("body"))


# STR10-STR15 ------------------------------------------------------------------
@register("str10_sentences", S.with_(S.SENTS) + "SELECT doc_id, sent_pos, sentence FROM sents")
def str10(spark, sf_dir):
    return _t(spark, sf_dir).sents.select("doc_id", F.col("sent_pos").cast("int").alias("sent_pos"), "sentence")


def _ws_sql(c):
    return f"trim(replace(replace(replace({c}, chr(160), ' '), '\\t', ' '), '_', ' '))"


@register("str11_15_sentence_steps", S.with_(S.SENTS) + f"""
SELECT doc_id, sent_pos,
  {_ws_sql('sentence')} AS repaired,
  regexp_replace(sentence, {Q(tx.HYPHEN_BREAK)}, '\\1\\2', 'g') AS unhyphenated,
  regexp_replace(sentence, {Q(tx.DIGITS)}, '', 'g') AS no_digits,
  regexp_replace(regexp_replace(sentence, {Q(tx.SINGLE_LETTER)}, '\\1\\2', 'g'), {Q(tx.SINGLE_LETTER)}, '\\1\\2', 'g')
    AS no_single_letters,
  regexp_replace(regexp_replace(sentence, {Q(tx.ACRONYM)}, '\\1', 'g'), {Q(tx.ACRONYM)}, '\\1', 'g') AS no_acronyms
FROM sents""")
def str11_15(spark, sf_dir):
    s = _t(spark, sf_dir).sents
    return s.select("doc_id", F.col("sent_pos").cast("int").alias("sent_pos"),
                    tx.repair_whitespace("sentence").alias("repaired"),
                    tx.unhyphenate("sentence").alias("unhyphenated"),
                    tx.remove_digits("sentence").alias("no_digits"),
                    tx.remove_single_letters("sentence").alias("no_single_letters"),
                    tx.remove_acronyms("sentence").alias("no_acronyms"))


# STR16-STR21 ------------------------------------------------------------------
@register("str16_tokens", S.with_(S.SENTS, S.TOKENS) + "SELECT doc_id, sent_pos, tok_pos, token FROM tokens")
def str16(spark, sf_dir):
    k = _t(spark, sf_dir).tokens
    return k.select("doc_id", F.col("sent_pos").cast("int").alias("sent_pos"),
                    F.col("tok_pos").cast("int").alias("tok_pos"), "token")


@register("str17_19_stop_junk_blacklist", S.with_(S.SENTS) + f"""
SELECT doc_id, sent_pos, array_to_string(kept, ' ') AS kept,
       list_contains({S.lst(lexicon.BLACKLIST_SENTENCES)}, array_to_string(kept, ' ')) AS blacklisted
FROM (SELECT doc_id, sent_pos, {S.drop_stop(S.tokenize('sentence'))} AS kept FROM sents)""")
def str17_19(spark, sf_dir):
    s = _t(spark, sf_dir).sents
    joined = F.array_join(tx.drop_stop_tokens(tx.tokenize("sentence")), " ")
    out = tx.let(joined, lambda k: F.struct(k.alias("kept"), k.isin(lexicon.BLACKLIST_SENTENCES).alias("blacklisted")))
    return s.select("doc_id", F.col("sent_pos").cast("int").alias("sent_pos"), out.alias("r")) \
        .select("doc_id", "sent_pos", "r.kept", "r.blacklisted")


@register("str18_general_stopwords", S.with_(S.SENTS, S.TOKENS) + f"""
SELECT d.doc_id, CAST(count(t.token) AS BIGINT) AS n_content_tokens
FROM documents d LEFT JOIN (SELECT * FROM tokens WHERE token NOT IN {S.inlist(lexicon.general_stop_list())}) t
  USING (doc_id)
GROUP BY d.doc_id""")
def str18(spark, sf_dir):
    # counted inside each row: no token leaves its document
    kept = F.transform(tx.sentences("text"), lambda s: F.size(F.filter(tx.tokenize(s), lambda w: ~w.isin(lexicon.general_stop_list()))))
    n = F.aggregate(kept, F.lit(0), lambda a, x: a + x)
    return _t(spark, sf_dir).documents.select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("n_content_tokens"))


# A larger list for the option: the archive's stop and junk words.
EXTENDED = lexicon.archive_stop_list()


@register("str18_extended_stopwords", S.with_(S.SENTS, S.TOKENS) + f"""
SELECT d.doc_id, CAST(count(t.token) AS BIGINT) AS n_content_tokens
FROM documents d LEFT JOIN (SELECT * FROM tokens WHERE token NOT IN {S.inlist(lexicon.general_stop_list(EXTENDED))}) t
  USING (doc_id)
GROUP BY d.doc_id""")
def str18_extended(spark, sf_dir):
    kept = F.transform(tx.sentences("text"), lambda s: F.size(F.filter(tx.tokenize(s), lambda w: ~tx.is_general_stop(w, EXTENDED))))
    n = F.aggregate(kept, F.lit(0), lambda a, x: a + x)
    return _t(spark, sf_dir).documents.select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("n_content_tokens"))


@register("str20_vocabulary_filter", S.with_(S.SENTS, S.TOKENS) + f"""
, vocab AS (SELECT DISTINCT unnest({S.tokenize('text')}) AS token FROM benchmark)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_known_tokens
FROM tokens SEMI JOIN vocab USING (token) GROUP BY doc_id""")
def str20(spark, sf_dir):
    t = _t(spark, sf_dir)
    vocab = t.benchmark.select(F.explode(tx.tokenize("text")).alias("token")).distinct()
    # a frequent token is one row per document
    per = t.tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return per.join(vocab, "token", "left_semi").groupBy("doc_id").agg(F.sum("n").alias("n_known_tokens"))


@register("str21_clean_documents", f"""
SELECT doc_id, CAST(len(doc) AS INTEGER) AS n_sents, CAST(len(flatten(doc)) AS INTEGER) AS n_tokens,
       {S.doc_string('doc')} AS cleaned
FROM (SELECT doc_id, {S.clean_document('text')} AS doc FROM documents)""")
def str21(spark, sf_dir):
    d = _t(spark, sf_dir).documents.select("doc_id", tx.clean_document("text").alias("doc"))
    return d.select("doc_id", F.size("doc").alias("n_sents"), F.size(F.flatten("doc")).alias("n_tokens"),
                    tx.doc_string("doc").alias("cleaned"))


# STR22-STR23 ------------------------------------------------------------------
MINLEN, MAXLEN = 100, 500
WC_SQL = (f"CASE WHEN length(regexp_replace(t, '^{tx.PY_WS}+|{tx.PY_WS}+$', '', 'g')) = 0 THEN 0 ELSE "
          f"len(string_split_regex(regexp_replace(t, '^{tx.PY_WS}+|{tx.PY_WS}+$', '', 'g'), '{tx.PY_WS}+')) END")


def _budgets(t: Tables, *keep: str):
    # a file with few row groups is read by few tasks: the texts are dealt out before they are counted, once
    d = t.documents.select("doc_id", "text").repartition("doc_id", "text")
    d = d.select("doc_id", *keep, tx.words_in(tx.strip_tags("text")).alias("n_words"))
    d = d if keep else reuse(d)
    span = d.agg(F.max("n_words").alias("longest"), F.min("n_words").alias("shortest"))  # one row
    return d.crossJoin(F.broadcast(span)).withColumn("budget", tx.length_budget("n_words", "longest", "shortest", MAXLEN, MINLEN))


BUDGET_SQL = f"""wc AS (SELECT doc_id, text, {WC_SQL} AS n_words FROM (SELECT doc_id, text, {S.strip_tags('text')} AS t FROM documents)),
ext AS (SELECT max(n_words) AS longest, min(n_words) AS shortest FROM wc),
bud AS (SELECT doc_id, text, n_words,
   CASE WHEN n_words > {MINLEN} THEN CAST(trunc({float(MINLEN)} + (n_words - shortest)::DOUBLE /
        ((longest - shortest)::DOUBLE / {float(MAXLEN - MINLEN)})) AS BIGINT) END AS budget
   FROM wc, ext)"""


@register("str22_length_budget", "WITH " + BUDGET_SQL + "\nSELECT doc_id, CAST(n_words AS INTEGER) AS n_words, budget FROM bud")
def str22(spark, sf_dir):
    return _budgets(_t(spark, sf_dir)).select("doc_id", "n_words", "budget")


@register("str23_cut_to_budget", "WITH " + BUDGET_SQL + f""",
cl AS (SELECT doc_id, budget, {S.clean_document('text')} AS doc FROM bud),
ex AS (SELECT doc_id, budget, unnest(doc) AS s, unnest(generate_series(1, len(doc))) AS pos FROM cl),
run AS (SELECT *, coalesce(sum(len(s)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ex),
cut AS (SELECT doc_id, pos, CASE WHEN budget IS NULL THEN s ELSE list_slice(s, 1, greatest(0, budget - before)) END AS s FROM run)
SELECT doc_id, CAST(sum(len(s)) AS INTEGER) AS n_kept,
       string_agg(array_to_string(s, ' '), chr(10) ORDER BY pos) AS kept
FROM cut WHERE len(s) > 0 GROUP BY doc_id""")
def str23(spark, sf_dir):
    b = _budgets(_t(spark, sf_dir), "text").select("doc_id", "budget", tx.clean_document("text").alias("doc"))
    c = b.select("doc_id", tx.cut_to_budget("doc", "budget").alias("doc"))
    # documents with nothing kept are dropped by a generator (no Filter node that
    # the optimizer would push down by copying the whole cleaning expression)
    out = F.transform(F.filter(F.array("doc"), lambda d: F.size(d) > 0),
                      lambda d: F.struct(F.size(F.flatten(d)).alias("n_kept"), tx.doc_string(d).alias("kept")))
    return c.select("doc_id", F.explode(out).alias("r")).select("doc_id", "r.n_kept", "r.kept")


# STR24-STR26 ------------------------------------------------------------------
def _alt_sql(c, fast=False):
    punct = "[" + "".join("\\" + ch for ch in tx.ALT_PUNCT) + "]+"
    pre = ["http", "https", "www", "//", "\\", "x_", "x/", "srcimage"]
    suf = [".com", ".net", ".gov", ".org", ".jpg", ".pdf", "png", "jpeg", "php"]
    link = " OR ".join(["contains(w, '@')"] + [f"starts_with(w, {Q(p)})" for p in pre] +
                       [f"ends_with(w, {Q(s)})" for s in suf])
    s = _ws_sql(c)
    if not fast:
        s = f"regexp_replace({s}, '[^\\x00-\\x7f]', '', 'g')"
        s = f"regexp_replace({s}, '\\\\x.*|\\\\u.*|\\\\b.*', '', 'g')"
    s = f"regexp_replace({s}, '{tx.DIGITS}', '', 'g')"
    words = f"list_filter(string_split_regex(trim({s}), '{tx.PY_WS}+'), lambda w: length(w) > 0 AND NOT ({'false' if fast else link}))"
    stripped = f"list_transform({words}, lambda w: trim(trim(regexp_replace(w, {Q(punct)}, '', 'g'), ''''), '-'))"
    stop = S.lst(lexicon.general_stop_list())
    return f"list_transform(list_filter({stripped}, lambda w: NOT list_contains({stop}, w)), lambda w: lower(w))"


@register("str24_clean_alt", f"""
SELECT conv_id, turn, array_to_string({_alt_sql('text')}, '|') AS words FROM conversations""")
def str24(spark, sf_dir):
    c = _t(spark, sf_dir).conversations
    return c.select("conv_id", "turn", F.array_join(tx.clean_alt("text"), "|").alias("words"))


@register("str24_clean_alt_fast", f"""
SELECT doc_id, array_to_string({_alt_sql('text', True)}, '|') AS words FROM documents""")
def str24_fast(spark, sf_dir):
    d = _t(spark, sf_dir).documents
    return d.select("doc_id", F.array_join(tx.clean_alt("text", fast=True), "|").alias("words"))


@register("str24_clean_alt_known", f"""
WITH vocab AS (SELECT DISTINCT unnest({S.tokenize('text')}) AS w FROM benchmark),
c AS (SELECT conv_id, turn, {_alt_sql('text')} AS words FROM conversations),
w AS (SELECT conv_id, turn, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM c),
k AS (SELECT conv_id, turn, string_agg(w, '|' ORDER BY p) AS words FROM w SEMI JOIN vocab USING (w) GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(k.words, '') AS words FROM c LEFT JOIN k USING (conv_id, turn)""")
def str24_known(spark, sf_dir):
    """The cleaner with a vocabulary (here the benchmark's words): other words go."""
    t = _t(spark, sf_dir)
    vocab = t.benchmark.select(F.explode(tx.tokenize("text")).alias("word"))
    c = t.conversations.select("conv_id", "turn", tx.clean_alt("text").alias("cleaned"))
    out = terms.keep_known(c, ["conv_id", "turn"], "cleaned", vocab, "word")
    return out.select("conv_id", "turn", F.array_join("known", "|").alias("words"))


def _tweet_sql(c):
    t = f"replace(replace(lower({c}), '# ', '#'), chr(10), ' ')"
    t = f"regexp_replace({t}, 'https?://[^\\s]*', '', 'g')"
    t = f"regexp_replace({t}, '@[^\\s]*', '', 'g')"
    t = f"trim(regexp_replace({t}, '{tx.PY_WS}+', ' ', 'g'))"
    t = f"regexp_replace({t}, '#([^\\s]+)', '\\1', 'g')"
    t = f"regexp_replace(trim(regexp_replace({t}, {Q(tx.EMOJI_CLASS)}, '', 'g')), ' +', ' ', 'g')"
    return f"CASE WHEN {c} IS NULL OR regexp_matches({c}, '^RT\\s+') THEN '' ELSE {t} END"


@register("str25_clean_tweets", f"""
SELECT conv_id, turn, cleaned FROM (SELECT conv_id, turn, {_tweet_sql('text')} AS cleaned FROM conversations)
WHERE cleaned <> ''""")
def str25(spark, sf_dir):
    c = _t(spark, sf_dir).conversations.select("conv_id", "turn", tx.clean_tweet("text").alias("cleaned"))
    return c.where(F.col("cleaned") != "")


def _freq_sql(c):
    punct = tx.FREQ_PUNCT
    t = f"translate(lower({c}), {Q(punct)}, {Q(' ' * len(punct))})"
    words = f"list_filter(string_split_regex(regexp_replace({t}, '^{tx.PY_WS}+|{tx.PY_WS}+$', '', 'g'), '{tx.PY_WS}+'), lambda w: length(w) > 0)"
    stop = S.lst(list(dict.fromkeys(lexicon.ENGLISH_STOP_WORDS + tx.FREQ_EXTRA_STOP)))
    words = f"list_filter({words}, lambda w: NOT list_contains({stop}, w))"
    words = f"list_filter(list_transform({words}, lambda w: regexp_replace(w, '[0-9]', '', 'g')), lambda w: length(w) > 1)"
    return f"CASE WHEN len({words}) > 0 THEN ' ' || array_to_string({words}, ' ') ELSE '' END"


@register("str26_frequency_words", f"SELECT doc_id, {_freq_sql('text')} AS words FROM documents")
def str26(spark, sf_dir):
    texts = _t(spark, sf_dir).documents.select("doc_id", "text").repartition("doc_id", "text")  # a file with few row groups is read by few tasks
    return texts.select("doc_id", tx.freq_words("text").alias("words"))


# STR27 ------------------------------------------------------------------------
@register("str27_flatten_document", f"""
SELECT doc_id, array_to_string(flatten(doc), ' ') AS flat_text
FROM (SELECT doc_id, {S.clean_document('text')} AS doc FROM documents)""")
def str27(spark, sf_dir):
    d = _t(spark, sf_dir).documents.select("doc_id", tx.clean_document("text").alias("doc"))
    return d.select("doc_id", F.array_join(tx.flatten_tokens("doc"), " ").alias("flat_text"))


# STR30-STR33 ------------------------------------------------------------------
@register("str30_label_to_number", """
SELECT doc_id, lbl, CAST(CASE WHEN lbl = 'no' THEN 0.0 WHEN lbl = 'yes' THEN 1.0 WHEN lbl = 'unsure' THEN 0.5 END AS DOUBLE) AS score
FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'unsure' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS lbl FROM labels)""")
def str30(spark, sf_dir):
    l = _t(spark, sf_dir).labels.select("doc_id", F.when(F.col("toxic") == 1, "unsure").when(
        F.col("quality") == 1, "yes").otherwise("no").alias("lbl"))
    return l.select("doc_id", "lbl", tx.label_to_number("lbl", has_unsure=True).alias("score"))


@register("str31_label_from_probability", S.with_(S.SCORES) + """
SELECT doc_id, prediction_cult, round(prediction_cult_prob_yes, 6) AS p_yes, round(prediction_cult_prob_no, 6) AS p_no,
       prediction_orgs FROM scores""")
def str31(spark, sf_dir):
    s = _t(spark, sf_dir).scores
    return s.select("doc_id", "prediction_cult", F.round("prediction_cult_prob_yes", 6).alias("p_yes"),
                    F.round("prediction_cult_prob_no", 6).alias("p_no"), "prediction_orgs")


@register("str32_coding_sheet", S.with_(S.ARTICLES) + """
SELECT '' AS coder_notes, '' AS coder_score, '' AS coder_name, doc_id, file_name, journal_title, publication_year
FROM articles WHERE primary_subject = 'Sociology'""")
def str32(spark, sf_dir):
    a = _t(spark, sf_dir).articles.where(F.col("primary_subject") == "Sociology")
    return a.select(F.lit("").alias("coder_notes"), F.lit("").alias("coder_score"), F.lit("").alias("coder_name"),
                    "doc_id", "file_name", "journal_title", "publication_year")


def _decade_sql(y):
    return "CASE " + " ".join(f"WHEN {y} BETWEEN {lo} AND {hi} THEN '{lo}_{hi}'" for lo, hi in tx.DECADES) + " END"


@register("str33_decade_slices", S.with_(S.ARTICLES) + f"""
SELECT decade, CAST(count(*) AS BIGINT) AS n_articles
FROM (SELECT {_decade_sql('publication_year')} AS decade FROM articles) GROUP BY decade""")
def str33(spark, sf_dir):
    a = _t(spark, sf_dir).articles
    return a.groupBy(tx.decade("publication_year").alias("decade")).agg(F.count(F.lit(1)).alias("n_articles"))


# STR34 ------------------------------------------------------------------------
SIM_SQL = """CAST(CASE WHEN greatest(length(a), length(b)) = 0 THEN 100
  ELSE round(100.0 * (1.0 - levenshtein(a, b) / greatest(length(a), length(b)))) END AS INTEGER)"""
PAIRS_SQL = S.with_(S.citations_cte(), S.doc_titles_cte(),
                    f"""pairs AS (SELECT c.cite_id, {S.fold_accents(S.normalize_title(S.CITE_TITLE))} AS a, {S.fold_accents('d.title')} AS b
  FROM citations c JOIN doc_titles d ON c.cite_id = 'd' || CAST(d.doc_id AS VARCHAR))""")


def title_pairs(t: Tables):
    """Each coded document's citation title next to its metadata title, accents folded."""
    c = t.citations.select("cite_id", tx.fold_accents(tx.citation_title("citation")).alias("a"))
    d = t.doc_titles.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("cite_id"),
                            tx.fold_accents("title").alias("b"))
    return c.join(d, "cite_id")


@register("str34_title_similarity", PAIRS_SQL + f"SELECT cite_id, {SIM_SQL} AS similarity FROM pairs")
def str34(spark, sf_dir):
    j = title_pairs(_t(spark, sf_dir))
    return j.select("cite_id", tx.similarity_ratio("a", "b").alias("similarity"))


@register("str34_exact_ratio")
def str34_exact(spark, sf_dir):
    """The exact ratio of both titles (no SQL states it: see tests/test_ratio.py)."""
    j = title_pairs(_t(spark, sf_dir))
    return j.select("cite_id", F.round(exact_ratio("a", "b"), 6).alias("ratio"))
