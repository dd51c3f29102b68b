"""SQL text (DuckDB dialect) for the oracle side of each registered query.

These mirror the Column functions of ``litspark.functions.text`` and the
derived views of ``litspark.sources.tables``; the oracle is an independent
engine run on the same parquet files.
"""

from __future__ import annotations

from litspark.functions import lexicon
from litspark.functions import text as tx
from litspark.sources.tables import FILE_PREFIX, MANAGEMENT, PERSPECTIVES, SOCIOLOGY


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def inlist(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def strip_tags(c: str, opener: str = tx.PAGE_OPENER) -> str:
    c = f"replace({c}, {q(opener)}, '')"
    c = f"regexp_replace({c}, '</page>(<.*?>)', ' ' || chr(10) || ' ', 'g')"
    c = f"regexp_replace({c}, '<.*?>', '', 'g')"
    return f"regexp_replace({c}, '<body.*\\n\\s*.*\\s*.*>', '', 'g')"


def prepare_text(c: str, tags: bool = True) -> str:
    if tags:
        c = strip_tags(c)
    c = f"replace(replace({c}, chr(160), ' '), '_', ' ')"
    c = f"replace({c}, '\\t', ' ')"
    c = f"regexp_replace({c}, {q(tx.HYPHEN_BREAK)}, '\\1\\2', 'g')"
    c = f"regexp_replace({c}, {q(tx.DIGITS)}, '', 'g')"
    c = f"regexp_replace({c}, {q(tx.SINGLE_LETTER)}, '\\1\\2', 'g')"
    return f"regexp_replace({c}, {q(tx.SINGLE_LETTER)}, '\\1\\2', 'g')"


def tokenize(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {q(tx.TOKEN_PATTERN)})"


def drop_stop(toks: str, stop_words: bool = True) -> str:
    stop = lst(lexicon.archive_stop_list(stop=stop_words))
    return f"list_filter({toks}, lambda t: NOT list_contains({stop}, t) AND NOT contains(t, 'valign'))"


def clean_document(c: str, stop_words: bool = True) -> str:
    bl = lst(lexicon.BLACKLIST_SENTENCES)
    inner = drop_stop(tokenize("s"), stop_words)
    per_sent = (f"list_transform(string_split({prepare_text(c)}, chr(10)), lambda s: "
                f"CASE WHEN list_contains({bl}, array_to_string({inner}, ' ')) THEN []::VARCHAR[] ELSE {inner} END)")
    return f"list_filter({per_sent}, lambda x: len(x) > 0)"


def doc_string(doc: str) -> str:
    return f"array_to_string(list_transform({doc}, lambda s: array_to_string(s, ' ')), chr(10))"


def normalize_title(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, {q(tx.NON_WORD + '+')}, ' ', 'g'), ' x'))"


ARTICLES = f"""articles AS (
  SELECT doc_id, text, source AS journal_title,
         CASE WHEN lang = 'en' THEN {q(SOCIOLOGY)} ELSE {q(MANAGEMENT)} END AS primary_subject,
         CAST(1970 + doc_id % 47 AS INTEGER) AS publication_year,
         {q(FILE_PREFIX)} || CAST(doc_id AS VARCHAR) AS file_name
  FROM documents)"""


def _score_cols() -> str:
    cols = []
    for p, prime in PERSPECTIVES.items():
        y = f"CAST((doc_id * {prime}) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)"
        cols.append(f"CASE WHEN {y} > 1.0 - {y} THEN 'yes' ELSE 'no' END AS prediction_{p}")
        cols.append(f"{y} AS prediction_{p}_prob_yes")
        cols.append(f"1.0 - {y} AS prediction_{p}_prob_no")
    return ",\n         ".join(cols)


SCORES = f"""scores AS (
  SELECT doc_id,
         {_score_cols()}
  FROM documents)"""

SENTS = """sents AS (
  SELECT doc_id, CAST(unnest(generate_series(0, len(arr) - 1)) AS INTEGER) AS sent_pos, unnest(arr) AS sentence
  FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents))"""

TOKENS = f"""tokens AS (
  SELECT doc_id, sent_pos, CAST(unnest(generate_series(0, len(arr) - 1)) AS INTEGER) AS tok_pos, unnest(arr) AS token
  FROM (SELECT doc_id, sent_pos, {tokenize('sentence')} AS arr FROM sents) WHERE len(arr) > 0)"""

CODED = """coded AS (
  SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS cultural_score, CAST(l.toxic AS DOUBLE) AS relational_score
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


FIRST8 = r"array_to_string(list_slice(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[ \t\n\r]+'), 1, 8), ' ')"


def fold_accents(s: str) -> str:
    return f"regexp_replace(translate(lower({s}), '{tx.ACCENTED}', '{tx.PLAIN}'), '[^\\x00-\\x7f]', '?', 'g')"


CITE_TITLE = r"substring(regexp_extract(trim(citation), '\d{4}\.(.*)[.?!].', 1), 3)"


def citations_cte() -> str:
    return f"""citations AS (
  SELECT cite_id, 'Doe, Jane.  ' || year || '.  ' || head || '.  Journal, 1 (2):  3-4.' AS citation FROM (
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS cite_id, CAST(1970 + doc_id % 47 AS VARCHAR) AS year, {FIRST8} AS head
    FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
    UNION ALL
    SELECT 'b' || CAST(item_id AS VARCHAR), CAST(1970 + item_id % 47 AS VARCHAR), {FIRST8} FROM benchmark))"""


def doc_titles_cte() -> str:
    return f"doc_titles AS (SELECT doc_id, {normalize_title(FIRST8)} AS title FROM documents)"


CLEAN_TOKENS = f"""clean AS (SELECT doc_id, {clean_document('text')} AS doc FROM documents),
ctok AS (SELECT doc_id, unnest(flatten(doc)) AS term FROM clean)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def WC_EXPR(c: str) -> str:
    """len(text.split()) in SQL."""
    t = f"regexp_replace({c}, '^{tx.PY_WS}+|{tx.PY_WS}+$', '', 'g')"
    return f"CASE WHEN length({t}) = 0 THEN 0 ELSE len(string_split_regex({t}, '{tx.PY_WS}+')) END"
