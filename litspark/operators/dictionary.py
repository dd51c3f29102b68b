"""Matching a table of terms of any size (FLT4, AGG26, STR28, JN10).

A text is a sequence of units, its words or its characters, and so is a term.
Every term is listed under one key: of its words, or of its runs of ``GRAM``
characters (a shorter term is its own key), the one that the fewest terms have.
A text's units are exploded once with the keys that begin there, the index joins
them by hash, and a match is kept if the text's units around it are the term's.
So a position meets only the terms listed under what stands there, and the plan
is the same for ten terms and for a hundred thousand.

The index is broadcast in blocks of about ``BLOCK_TERMS`` terms, counted before;
the matches of all blocks are united. Generating the positions, the lookup and
the comparison are one stage without a shuffle.

Null and empty texts have no match; null and empty terms are left out; a match
may overlap another one; a term given twice matches once for each row of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions import text as tx
from litspark.operators.aggregates import join_null_safe
from litspark.session import small_result

GRAM = 5
#: Characters on either side of a space that a term of several words is listed under.
SEAM = 3
BLOCK_TERMS = 100_000


def characters(text) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "")


def words(term) -> Column:
    return F.filter(F.split(F.trim(term), r"\s+"), lambda w: F.length(w) > 0)


def _runs(units: Column, width: int) -> Column:
    """array<struct<u0..>>: every unit with those behind it, null beyond the end."""
    return F.arrays_zip(*[(units if k == 0 else F.slice(units, k + 1, F.greatest(F.size(units) - k, F.lit(0)))).alias(f"u{k}")
                          for k in range(width)])


def _key(run: str, size: int) -> Column:
    return F.concat(*[F.col(f"{run}.u{k}") for k in range(size)])


class TermIndex:
    """Terms by their keys. ``terms`` keeps its columns beside each match."""

    def __init__(self, terms: DataFrame, term_col: str, by_words: bool):
        units = words(F.col(term_col)) if by_words else characters(term_col)
        listed = terms.withColumn("_units", units).where(F.coalesce(F.length(term_col), F.lit(0)) > 0).where(F.size("_units") > 0)
        gram = 1 if by_words else GRAM
        each = listed.select("_units").distinct().withColumn("_size", F.least(F.size("_units"), F.lit(gram)))
        run = each.select("*", F.posexplode(_runs(F.col("_units"), gram)).alias("_at", "_run"))
        key = reduce(lambda out, k: out.when(F.col("_size") == k, _key("_run", k)), range(2, gram + 1), F.when(F.col("_size") == 1, _key("_run", 1)))
        keys = run.withColumn("_key", key).where(F.col("_key").isNotNull())
        length = keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
        rarest = keys.join(length, "_key").groupBy("_units", "_size").agg(F.min(F.struct("_n", "_at", "_key")).alias("_k"))
        self.rows = small_result(listed.join(rarest, "_units").select(
            *terms.columns, "_units", "_size", F.col("_k._key").alias("_key"), F.col("_k._at").alias("_at")))
        self.count = self.rows.count()
        self.sizes = sorted(r["_size"] for r in self.rows.select("_size").distinct().collect())  # at most GRAM numbers
        self.columns = terms.columns

    def blocks(self) -> list[DataFrame]:
        n = max(1, -(-self.count // BLOCK_TERMS))
        return [F.broadcast(self.rows if n == 1 else self.rows.where(F.pmod(F.xxhash64("_units"), F.lit(n)) == b)) for b in range(n)]


def occurrences(df: DataFrame, units: str, index: TermIndex) -> DataFrame:
    """One row per match: the columns of ``df`` but ``units``, those of the terms,
    ``start`` (1-based unit) and ``n`` (units). The names must not clash."""
    keep = [c for c in df.columns if c != units]
    if not index.sizes:
        empty = index.rows.select(*index.columns, F.lit(1).alias("start"), F.lit(1).alias("n"))
        return df.select(*keep).join(F.broadcast(empty), F.lit(False))
    at = df.select(*keep, F.col(units).alias("_text"), F.posexplode(_runs(F.col(units), max(index.sizes))).alias("_pos", "_run"))
    keys = F.array(*[_key("_run", k) for k in index.sizes])
    at = at.withColumn("_key", keys[0]) if len(index.sizes) == 1 else at.withColumn("_key", F.explode(keys))
    at = at.where(F.col("_key").isNotNull()).drop("_run")
    start = F.col("_pos") - F.col("_at") + 1
    found = [at.join(block, "_key").where(start >= 1).where(F.slice("_text", F.greatest(start, F.lit(1)), F.size("_units")) == F.col("_units"))
             for block in index.blocks()]
    return reduce(DataFrame.unionByName, found).select(*keep, *index.columns, start.alias("start"), F.size("_units").alias("n"))


def with_hits(df: DataFrame, key: str, text: str, terms: DataFrame, term_col: str = "term", name: str = "hit") -> DataFrame:
    """FLT4: ``df`` and whether the text holds a term as a substring, bounded by
    words or not. ``key`` names a row; a term lies within a line of its text."""
    index = TermIndex(terms.select(F.col(term_col).alias("_term")), "_term", by_words=False)
    lines = df.select(F.col(key).alias("_row"), F.explode(F.split(text, "\n")).alias("_line"))
    hits = occurrences(lines.select("_row", characters("_line").alias("_chars")), "_chars", index).select("_row").distinct()
    flagged = join_null_safe(df, hits.select(F.col("_row").alias(key), F.lit(True).alias(name)), [key], "left")
    return flagged.withColumn(name, F.coalesce(name, F.lit(False)))


def hit_counts(sents: DataFrame, keys: list[str], toks: str, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """AGG26: how often the words of a term follow each other in the sentences, by
    ``keys`` and the other columns of ``terms``."""
    by = [c for c in terms.columns if c != term_col]
    found = occurrences(sents.select(*keys, F.col(toks).alias("_toks")), "_toks", TermIndex(terms, term_col, by_words=True))
    return found.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("n_hits"))


def _seam(left: Column, right: Column, p: int, q: int) -> Column:
    return F.concat(F.right(left, F.lit(p)), F.lit(" "), F.left(right, F.lit(q)))


def _term_matches(sents: DataFrame, keys: list[str], toks: str, several: DataFrame) -> DataFrame:
    """(keys..., _term, start, n): where the sentences hold terms of several words
    as substrings. Such a term has a space: it is listed under the characters at
    its first one, and only the seams between two words are looked up."""
    listed = several.withColumn("_w", words(F.col("_term"))).withColumn("_p", F.least(F.length(F.col("_w")[0]), F.lit(SEAM))) \
        .withColumn("_q", F.least(F.length(F.col("_w")[1]), F.lit(SEAM)))
    sizes = [(p, q) for p in range(1, SEAM + 1) for q in range(1, SEAM + 1)]
    key = reduce(lambda out, s: out.when((F.col("_p") == s[0]) & (F.col("_q") == s[1]), _seam(F.col("_w")[0], F.col("_w")[1], *s)), sizes, F.when(F.lit(False), F.lit("")))
    index = small_result(listed.select("_term", "_w", F.struct("_p", "_q").alias("_size"), key.alias("_key")))
    count = index.count()
    used = [(r["_size"]["_p"], r["_size"]["_q"]) for r in index.select("_size").distinct().collect()]  # at most SEAM^2 pairs
    if not used:
        return sents.select(*keys, F.lit("").alias("_term"), F.lit(1).alias("start"), F.lit(1).alias("n")).where(F.lit(False))
    tk = F.col(toks)
    m = F.greatest(F.size(tk) - 1, F.lit(1))
    pairs = F.when(F.size(tk) > 1, F.arrays_zip(F.slice(tk, 1, m).alias("a"), F.slice(tk, 2, m).alias("b"))).otherwise(
        F.array().cast("array<struct<a:string,b:string>>"))
    at = sents.select(*keys, tk.alias("_toks"), F.posexplode(pairs).alias("_pos", "_pair"))
    a, b = F.col("_pair.a"), F.col("_pair.b")
    seams = F.array_distinct(F.array(*[_seam(a, b, p, q) for p, q in used]))
    at = at.withColumn("_key", seams[0] if len(used) == 1 else F.explode(seams))
    n = max(1, -(-count // BLOCK_TERMS))
    before = F.length(a) - F.length(F.col("_w")[0])
    here = F.substring(F.array_join(F.slice("_toks", F.col("_pos") + 1, F.size("_w")), " "), before + 1, F.length("_term"))
    found = [at.join(F.broadcast(index if n == 1 else index.where(F.pmod(F.xxhash64("_term"), F.lit(n)) == k)), "_key").where((before >= 0) & (here == F.col("_term")))
             for k in range(n)]
    front = F.length(F.array_join(F.slice("_toks", 1, F.col("_pos")), " ")) + F.when(F.col("_pos") > 0, 1).otherwise(0)
    return reduce(DataFrame.unionByName, found).select(*keys, "_term", (front + before + 1).alias("start"), F.length("_term").alias("n"))


def join_terms(sents: DataFrame, keys: list[str], toks: str, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """STR28: the spaces inside each term of several words become '_' wherever the
    sentence holds it as a substring, longest terms first (by words, characters,
    then the term), each from left to right; adds ``fixed``, the words after that.

    A match counts while none of its spaces is taken and, for one term, if it
    begins behind the last one: what replacing term after term does. All matches
    of a sentence meet in its row. ``keys`` name a sentence; its words hold no
    spaces."""
    several = terms.select(F.trim(F.regexp_replace(term_col, r"\s+", " ")).alias("_term")).where(F.contains("_term", F.lit(" "))).distinct()
    sents = sents.withColumn("_text", F.array_join(F.col(toks), " "))  # half the bytes of the words, where only it is asked for
    text = F.col("_text")
    found = _term_matches(sents, keys, toks, several)
    order = F.struct((-F.size(F.split("_term", " "))).alias("w"), (-F.col("n")).alias("l"), F.col("_term").alias("term"), F.col("start").alias("start"))
    per = found.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("_found"))  # matches of one sentence
    state = F.struct(F.array().cast("array<int>").alias("taken"), F.lit("").alias("term"), F.lit(0).alias("end"))

    def take(s, o):
        letters = F.split(o["term"], "")
        inside = F.filter(F.sequence(F.lit(1), F.size(letters)), lambda i: F.element_at(letters, i) == " ")
        spaces = F.transform(inside, lambda i: i + o["start"] - 1)
        free = ~F.arrays_overlap(s["taken"], spaces) & ((o["term"] != s["term"]) | (o["start"] >= s["end"]))
        return F.when(free, F.struct(F.concat(s["taken"], spaces).alias("taken"), o["term"].alias("term"), (o["start"] - o["l"]).alias("end"))).otherwise(s)

    taken = per.select(*keys, F.aggregate("_found", state, take)["taken"].alias("_taken"))
    both = join_null_safe(sents, taken, keys, "left")

    def joined(chars):
        return F.array_join(F.transform(chars, lambda c, i: F.when(F.array_contains("_taken", i + 1), F.lit("_")).otherwise(c)), "")

    fixed = F.when(F.col("_taken").isNull(), text).otherwise(tx.let(characters(text), joined))
    return both.withColumn("fixed", F.split(F.trim(fixed), r"\s+")).drop("_taken", "_text")
