"""Word lists the cleaning steps need.

FIXED VALUES: the lists below must equal the original pipeline's lists for the
cleaned output to match; they are stated plainly, in their natural order.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterable

# --- fixed values -----------------------------------------------------------
# Stop words used for the archive's n-gram files.
ARCHIVE_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]

# Formatting debris common in the OCR texts.
JUNK_WORDS = [
    "colwidth", "colname", "char", "rowsep", "colsep", "oasis", "pp", "fn", "sec",
    "pi", "sc", "id", "cyr", "extcyr", "caption", "newcommand", "normalfont",
    "selectfont", "documentclass", "aastex", "declaremathsizes",
    "declaretextfontcommand", "pagestyle", "xlink:type", "sub", "sup", "nameend",
    "pgwide", "tbody", "tgroup", "sup", "tbfna", "morerows", "xlink:href",
    "fg.tiff", "tb.eps", "df.eps", "χ", "xmlns:oasis", "dtd", "drd",
    "xmlns:oasis", "http", "docs.oasis", "open.org ns",
]

# Any token containing this substring is dropped as well.
JUNK_SUBSTRING = "valign"

# Whole sentences (tokens joined by one space) made only of formatting words.
BLACKLIST_SENTENCES = [
    "valign bottom oasis entry oasis entry colname colsep rowsep align char char",
    "oasis entry oasis entry colname colsep rowsep align char char",
    "oasis entry colname colsep rowsep align char char",
    "valign bottom oasis entry colname colsep rowsep align char char",
    "colsep rowsep oasis entry align char char",
    "oasis entry oasis entry colsep rowsep align char char",
    "colsep rowsep oasis entry oasis entry align char char",
    "bottom entry", "align center", "align left", "colspec colnum",
    "usepackage amsbsy", "usepackage amsfonts", "usepackage amssymb",
    "usepackage bm", "usepackage mathrsfs", "usepackage pifont",
    "usepackage stmaryrd", "usepackage textcomp", "position float", "alt version",
    "mimetype image", "italic italic", "italic ij", "begin document",
    "inline formula", "entry namest", "frame topbot", "orient port", "list item",
    "table wrap", "tbody top", "disp formula", "fig group", "top entry",
    "tex math notation latex", "usepackage amsmath amsxtra",
    "usepackage ot ot fontenc", "renewcommand rmdefault wncyr",
    "renewcommand sfdefault wncyss", "renewcommand encodingdefault ot",
    "end document tex math", "entry align entry", "entry align left top",
    "align right", "table wrap foot", "top break entry",
    "table xml exchange table model en", "exchange table", "label table label",
    "tgroup cols align left", "disp formula df", "entry align left top entry",
    "fig position float fig type figure", "fig group", "graphic ",
    "bottom yes entry", "bottom model entry", "bottom sd entry",
    "entry align left top italic df  italic lt entry", "graphic tb eps",
    "bottom mean entry", "bottom mse entry", "bottom total entry",
    "italic df italic two tailed entry", "label fig label",
    "bottom configuration sets entry", "bottom continuation rate entry",
    "bottom continuation rate other configurations entry",
    "italic white boys risk italic", "bottom italic df italic entry",
]

# Common English function words (the widely published NLTK English list).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it",
    "it's", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "that'll", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with",
    "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on",
    "off", "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't",
    "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain",
    "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn",
    "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't",
    "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren",
    "weren't", "won", "won't", "wouldn", "wouldn't",
]
# --- end of fixed values ----------------------------------------------------


def archive_stop_list(stop: bool = True, junk: bool = True) -> list[str]:
    """Stop words, junk words or both (deduplicated, first occurrence kept)."""
    out: list[str] = []
    if stop:
        out += ARCHIVE_STOP_WORDS
    if junk:
        out += JUNK_WORDS
    return list(dict.fromkeys(out))


def general_stop_list(extend: Iterable[str] = ()) -> list[str]:
    """English stop words, month names in title and lower case, the numbers
    1..2099 written as strings (built from rules), and the words of a larger
    list, if one is given (``files.read_dictionary`` reads such a list)."""
    months = [calendar.month_name[i] for i in range(1, 13)]
    words = ENGLISH_STOP_WORDS + months + [m.lower() for m in months]
    words += [str(i) for i in range(1, 2100)]
    return list(dict.fromkeys([*words, *extend]))
