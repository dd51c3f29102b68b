"""Text cleaning and tokenising as built-in Column expressions.

Every function takes and returns a ``Column``; nothing here leaves the JVM but
``words_in`` and ``freq_words``, which take a text's words in Python.
Character classes are written out (``\\p{L}``...) instead of ``\\w``/``\\b``
so that the meaning is the Unicode one of the original Python code and the same
pattern runs unchanged in RE2-based engines used as oracles.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark.functions import lexicon

# Python's Unicode \w, \W and \d.
WORD_CHAR = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
DIGITS = r"\p{Nd}+"
# Python's str.split() whitespace set.
PY_WS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Word tokens: letter/mark/number runs, with inner apostrophe, period or colon
# followed by letters (keeps "xlink:href", "docs.oasis", "don't").
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}]+(?:[.:'’][\p{L}\p{M}]+)*"
SINGLE_LETTER = r"(^|" + NON_WORD + r")[a-zA-Z]($|" + NON_WORD + r")"
ACRONYM = r"(^|" + NON_WORD + r")[A-Z][A-Z]+" + r"[\t\n\x0b\x0c\r ]+"
HYPHEN_BREAK = r"(" + WORD_CHAR + r"+)- (" + WORD_CHAR + r"+)"
# The same two patterns for the JVM engine, with look-arounds (one pass, no
# retries inside a word). They match exactly what the portable forms above
# match; the portable forms serve engines without look-around.
HYPHEN_BREAK_JVM = r"(?<!" + WORD_CHAR + r")(" + WORD_CHAR + r"++)- (" + WORD_CHAR + r"+)"
SINGLE_LETTER_JVM = r"(?<!" + WORD_CHAR + r")[a-zA-Z](?!" + WORD_CHAR + r")"
PAGE_OPENER = '<plain_text><page sequence="1">'
PAGE_OPENER_SPACED = '<plain_text> <page sequence="1">'
# Characters the frequency cleaner turns into spaces (fixed value).
FREQ_PUNCT = "!()-[]{};:'\"\\, <>./?@#$%^&*_~=\n"
# Words the frequency cleaner drops besides the stop words (fixed value).
FREQ_EXTRA_STOP = ["one", "two", "three", "amp", "may", "can", "new", "also", "and"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``: the value
    becomes a lambda variable, so the optimizer cannot copy the expression that
    produced it into every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- STR1-STR7: ids, paths, titles, years -----------------------------------

def strip_scheme(url, https: bool = False) -> Column:
    """Part after the first 'http://' (or 'https://'); the input when absent."""
    url = _c(url)
    sep = "https://" if https else "http://"
    return F.coalesce(F.try_element_at(F.split(url, sep.replace(".", r"\.")), F.lit(2)), url)


def id_from_filename(fname) -> Column:
    """Last '-' separated part without its 4-character suffix."""
    last = F.substring_index(_c(fname), "-", -1)
    return last.substr(F.lit(1), F.greatest(F.length(last) - 4, F.lit(0)))


def path_for_id(doc_id, prefix: str, suffix: str = ".txt") -> Column:
    return F.concat(F.lit(prefix), F.lit("journal-article-"), _c(doc_id).cast("string"), F.lit(suffix))


def normalize_title(title) -> Column:
    """Non-word runs to one space, strip spaces and 'x' at both ends, lower."""
    t = F.regexp_replace(_c(title), NON_WORD + "+", " ")
    return F.lower(F.btrim(t, F.lit(" x")))


def citation_title(citation) -> Column:
    """Title of an ASA citation: text after 'dddd.' up to the last '.', '?' or
    '!' that has a following character; two leading characters dropped."""
    grp = F.regexp_extract(F.trim(_c(citation)), r"\d{4}\.(.*)[.?!].", 1)
    return normalize_title(F.substring(grp, 3, 1 << 30))


def digits_only(c) -> Column:
    return F.regexp_replace(_c(c), r"\D+", "")


def year_int(c) -> Column:
    """int(x), else int(first four characters)."""
    c = _c(c)
    whole = F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("int"))
    head = F.left(c, F.lit(4))
    return F.coalesce(whole, F.when(head.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(head).try_cast("int")))


# --- STR8-STR15: tags, whitespace, hyphens, numbers, letters ------------------

def strip_tags(c, opener: str = PAGE_OPENER) -> Column:
    """Page-marker and tag removal in the original order (no DOTALL)."""
    # fixed values: the tag patterns
    c = F.replace(_c(c), F.lit(opener), F.lit(""))
    c = F.regexp_replace(c, r"(?d)</page>(<.*?>)", " \n ")
    c = F.regexp_replace(c, r"(?d)<.*?>", "")
    return F.regexp_replace(c, r"(?d)<body.*\n\s*.*\s*.*>", "")


def _spaces(c: Column) -> Column:
    """NBSP, underscore and the two characters backslash-t become spaces
    (plain replacements: cheaper than translate)."""
    for old in ("\u00a0", "_", "\\t"):
        c = F.replace(c, F.lit(old), F.lit(" "))
    return c


def repair_whitespace(c) -> Column:
    """NBSP, literal backslash-t and underscore to space; trim spaces."""
    return F.trim(_spaces(_c(c)))


def unhyphenate(c) -> Column:
    return F.regexp_replace(_c(c), HYPHEN_BREAK_JVM, "$1$2")


def remove_digits(c) -> Column:
    return F.regexp_replace(_c(c), DIGITS, "")


def remove_single_letters(c) -> Column:
    """Drop one-letter ASCII words (Unicode word boundaries on both sides)."""
    return F.regexp_replace(_c(c), SINGLE_LETTER_JVM, "")


def remove_acronyms(c) -> Column:
    """Drop runs of two or more capitals followed by whitespace (two passes,
    as for single letters)."""
    return F.regexp_replace(F.regexp_replace(_c(c), ACRONYM, "$1"), ACRONYM, "$1")


def sentences(c) -> Column:
    """Newline split: one element per line, empty lines kept."""
    return F.split(_c(c), "\n")


# --- STR16-STR21: tokens and the full cleaner ---------------------------------

def tokenize(c, lowercase: bool = True) -> Column:
    c = _c(c)
    return F.regexp_extract_all(F.lower(c) if lowercase else c, F.lit(TOKEN_PATTERN), F.lit(0))


def drop_stop_tokens(tokens, stop: bool = True, junk: bool = True) -> Column:
    words = lexicon.archive_stop_list(stop=stop, junk=junk)  # isin becomes a hash-set lookup
    return F.filter(_c(tokens), lambda t: ~t.isin(words) & ~t.contains(lexicon.JUNK_SUBSTRING))


def prepare_text(c, remove_numbers: bool = True, unhyphen: bool = True,
                 acronyms: bool = False, tags: bool = True) -> Column:
    """Document-level regex steps. Each is line-local, so running them on the
    whole text equals running them per sentence."""
    c = _c(c)
    if tags:
        c = strip_tags(c)
    c = _spaces(c)
    if unhyphen:
        c = unhyphenate(c)
    if remove_numbers:
        c = remove_digits(c)
    c = remove_single_letters(c)
    if acronyms:
        c = remove_acronyms(c)
    return c


def clean_document(c, remove_stopwords: bool = True, **kw) -> Column:
    """Text -> array<array<string>>: cleaned token lists per sentence, empty
    sentences removed (STR21)."""
    sents = sentences(prepare_text(c, **kw))
    toks = F.transform(sents, lambda s: drop_stop_tokens(tokenize(s), stop=remove_stopwords, junk=True))
    # empty and formatting-only sentences go in one filter; each token list is
    # built once (a lambda variable, not a repeated expression)
    return F.filter(toks, lambda s: (F.size(s) > 0) & ~F.array_join(s, " ").isin(lexicon.BLACKLIST_SENTENCES))


def flatten_tokens(doc) -> Column:
    return F.flatten(_c(doc))


def doc_string(doc, sent_sep: str = "\n") -> Column:
    """array<array<string>> -> one string (STR27)."""
    return F.array_join(F.transform(_c(doc), lambda s: F.array_join(s, " ")), sent_sep)


def word_count(c) -> Column:
    """len(text.split())"""
    t = F.regexp_replace(_c(c), "^" + PY_WS + "+|" + PY_WS + "+$", "")
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.size(F.split(t, PY_WS + "+")))


def words_in(c) -> Column:
    """``word_count`` of long texts: counted in Python, batch by batch; white
    space is the same set there."""
    return F.udf(lambda t: None if t is None else len(t.split()), "int", useArrow=True)(_c(c))


# --- STR22-STR23: length budget -------------------------------------------

def length_budget(length, longest, shortest, maxlen, minlen) -> Column:
    """int(minlen + (len - shortest) / ((longest - shortest) / (maxlen - minlen)));
    documents at or under minlen words keep everything (NULL budget)."""
    length = _c(length)
    gap = F.lit(float(maxlen - minlen))
    disc = (_c(longest) - _c(shortest)).cast("double") / gap
    raw = F.lit(float(minlen)) + F.try_divide((length - _c(shortest)).cast("double"), disc)
    return F.when(length > minlen, raw.cast("long"))


def cut_to_budget(doc, budget) -> Column:
    """Keep sentences until ``budget`` words; the crossing sentence is cut."""
    # one left-to-right pass carrying the words used so far; the document is
    # referenced once, so the expression that produced it is evaluated once
    limit = F.coalesce(_c(budget).cast("int"), F.lit(2 ** 31 - 1))  # NULL budget: keep everything
    init = F.struct(F.lit(0).alias("used"), F.array().cast("array<array<string>>").alias("out"))
    res = F.aggregate(_c(doc), init, lambda acc, s: F.struct(
        (acc["used"] + F.size(s)).alias("used"),
        F.concat(acc["out"], F.array(F.slice(s, 1, F.greatest(F.lit(0), limit - acc["used"])))).alias("out")))
    return F.filter(res["out"], lambda s: F.size(s) > 0)


# --- STR24-STR26: alternative cleaners ----------------------------------------

# ASCII punctuation except the hyphen and the apostrophe (kept inside words)
ALT_PUNCT = "".join(ch for ch in string.punctuation if ch not in "-'")


def is_general_stop(w: Column, extend=()) -> Column:
    """Membership in the general stop list and a larger one, if given: the word list is a small hash-set
    lookup and the numbers 1..2099 are tested by rule, so no expression carries
    thousands of literals."""
    words = [x for x in lexicon.general_stop_list(extend) if not x.isdigit() or x in set(extend)]
    number = w.rlike("^[1-9][0-9]{0,3}$") & (w.try_cast("int") <= 2099)
    return w.isin(words) | number


def clean_alt(c, remove_stopwords: bool = True, exclude=(), fast: bool = False, extend=()) -> Column:
    """Alternative cleaner: non-ASCII out, escape tails out, numbers out, split
    on whitespace, e-mails/URLs/files out, punctuation out (inner - and ' kept),
    stop words (and those of a larger list, ``extend``) and an exclude list out,
    lower case. ``fast`` leaves non-ASCII
    characters, escapes and links alone. (The list of escaped characters and the
    star at a sentence's end are all non-ASCII, or hold an underscore that is a
    space by then: behind the first rule they never match.)"""
    c = repair_whitespace(c)
    if not fast:
        c = F.regexp_replace(c, r"[^\x00-\x7f]", "")
        c = F.regexp_replace(c, r"(?d)\\x.*|\\u.*|\\b.*", "")
    c = F.regexp_replace(c, DIGITS if fast else r"\d+", "")
    words = F.split(F.trim(c), PY_WS + "+")
    # fixed values: beginnings and ends of words that are links or files
    prefixes = ["http", "https", "www", "//", "\\", "x_", "x/", "srcimage"]
    suffixes = [".com", ".net", ".gov", ".org", ".jpg", ".pdf", "png", "jpeg", "php"]

    def is_link(w):
        cond = w.contains("@")
        for p in prefixes:
            cond = cond | w.startswith(p)
        for s in suffixes:
            cond = cond | w.endswith(s)
        return cond

    kept = F.filter(words, lambda w: (F.length(w) > 0) & (F.lit(True) if fast else ~is_link(w)))
    cls = "[" + "".join("\\" + ch for ch in ALT_PUNCT) + "]+"
    stripped = F.transform(kept, lambda w: F.btrim(F.btrim(F.regexp_replace(w, cls, ""), F.lit("'")), F.lit("-")))
    excl = list(dict.fromkeys(exclude))

    def dropped(w):
        cond = is_general_stop(w, extend) if remove_stopwords else F.lit(False)
        return (cond | w.isin(excl)) if excl else cond

    out = F.filter(stripped, lambda w: ~dropped(w))
    return F.transform(out, lambda w: F.lower(w))


def clean_tweet(c) -> Column:
    """Tweet cleaner; '' for retweets and NULLs (rows to be filtered after)."""
    c = _c(c)
    t = F.lower(c)
    t = F.replace(t, F.lit("# "), F.lit("#"))
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    t = F.regexp_replace(t, r"https?://[^\s]*", "")
    t = F.regexp_replace(t, r"@[^\s]*", "")
    t = F.regexp_replace(t, PY_WS + "+", " ")
    t = F.trim(t)
    t = F.regexp_replace(t, r"#([^\s]+)", "$1")
    t = F.regexp_replace(t, EMOJI_CLASS, "")
    t = F.regexp_replace(F.trim(t), " +", " ")
    return F.when(c.isNull() | c.rlike(r"^RT\s+"), F.lit("")).otherwise(t)


# Emoji blocks (pictographs, symbols, dingbats, flags, variation selector, ZWJ).
EMOJI_CLASS = (r"[\x{1F300}-\x{1FAFF}\x{1F000}-\x{1F2FF}\x{2600}-\x{27BF}"
               r"\x{1F1E6}-\x{1F1FF}\x{FE0F}\x{200D}\x{2B00}-\x{2BFF}]")


def freq_words(c) -> Column:
    """Frequency-count cleaner: lower, listed punctuation to space, split,
    stop words out, ASCII digits out of words, words of length <= 1 out;
    returns ' w1 w2 ...' or ''. The words are taken in Python, batch by batch:
    one expression per word costs many times that."""
    stop = frozenset(lexicon.ENGLISH_STOP_WORDS + FREQ_EXTRA_STOP)

    def clean(text):
        text = text or ""
        for mark in FREQ_PUNCT:
            text = text.replace(mark, " ")
        kept = " ".join([w for w in text.split() if w not in stop])
        for digit in string.digits:
            kept = kept.replace(digit, "")
        return "".join([" " + w for w in kept.split(" ") if len(w) > 1])

    return F.udf(clean, "string", useArrow=True)(F.lower(_c(c)))


# --- STR30-STR33: labels and buckets -------------------------------------------

def label_to_number(c, has_unsure: bool = False) -> Column:
    c = F.lower(F.trim(_c(c)))
    out = F.when(c == "no", F.lit(0.0)).when(c == "yes", F.lit(1.0))
    if has_unsure:
        out = out.when(c == "unsure", F.lit(0.5))
    return out


def label_from_prob(p_yes) -> Column:
    """'yes' only when p_yes > p_no = 1 - p_yes (a tie is 'no')."""
    p = _c(p_yes)
    return F.when(p > (F.lit(1.0) - p), F.lit("yes")).otherwise(F.lit("no"))


# The four closed year ranges of the decade slices.
DECADES = [(1971, 1981), (1982, 1992), (1993, 2003), (2004, 2014)]


def decade(year) -> Column:
    """Decade slice label: four closed ranges; NULL outside them."""
    y = _c(year)
    out = None
    for lo, hi in DECADES:
        cond = y.between(lo, hi)
        out = F.when(cond, F.lit(f"{lo}_{hi}")) if out is None else out.when(cond, F.lit(f"{lo}_{hi}"))
    return out


# --- STR34: title similarity ------------------------------------------------------

# Accented lower-case letters and the plain letters that stand for
# them when titles are compared; any other non-ASCII character becomes '?'.
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
PLAIN = "aaaaaaaceeeeiiiinooooooouuuuyys"


def fold_accents(c) -> Column:
    """Lower case, accents folded, one plain character per character."""
    return F.regexp_replace(F.translate(F.lower(_c(c)), ACCENTED, PLAIN), r"[^\x00-\x7f]", "?")


def similarity_ratio(a, b) -> Column:
    """0-100 similarity of two lower-cased strings from the edit distance."""
    def ratio(a, b):
        longest = F.greatest(F.length(a), F.length(b))
        return F.when(longest == 0, F.lit(100)).otherwise(
            F.round(F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / longest)).cast("int"))
    return let(F.lower(_c(a)), lambda x: let(F.lower(_c(b)), lambda y: ratio(x, y)))
