"""Joins and record linkage (JN*)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions import text as tx
from litspark.functions.edits import Texts
from litspark.operators.dictionary import TermIndex, characters, occurrences
from litspark.session import cut_lineage, small_result


class KeyViolation(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            .withColumn("side", F.lit(side)))


def one_to_one_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys repeated on either side (what a 1:1 validation rejects)."""
    return duplicate_keys(left, keys, "left").unionByName(duplicate_keys(right, keys, "right"))


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that fails when a key repeats on either side."""
    bad = one_to_one_report(left, right, keys).limit(5).collect()
    if bad:
        raise KeyViolation(f"keys are not unique: {[r.asDict() for r in bad]}")
    return left.join(right, keys, how)


def join_with_fallback(left: DataFrame, right: DataFrame, keys: list[str], value: str,
                       fallback: str, out: str) -> DataFrame:
    """Left join, then the joined value or the row's own imperfect value; the
    untouched copy stays in ``fallback``."""
    return left.join(right, keys, "left").withColumn(out, F.coalesce(F.col(value), F.col(fallback)))


def staged_link(records: DataFrame, first: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """Two-stage linkage: match on a filtered list, then the rest on the full
    list; matched rows of both stages unioned with a ``stage`` column."""
    m1 = records.join(first, key, "inner").withColumn("stage", F.lit(1))
    rest = records.join(first.select(key), key, "left_anti")
    m2 = rest.join(full, key, "inner").withColumn("stage", F.lit(2))
    common = [c for c in m1.columns if c in m2.columns]
    return m1.select(common).unionByName(m2.select(common))


#: Edits that the segment index looks for at most, and the least characters of a
#: segment: shorter titles are looked up with fewer edits.
EDITS = 5
SEGMENT = 5
#: Names that give every title a first best before all names are looked at.
SEEDS = 2_000
#: Titles that are sent to the tasks at a time.
SENT_TITLES = 5_000


def _score(title: Column, name: Column) -> Column:
    """Similarity of two folded titles."""
    longest = F.greatest(F.length(title), F.length(name))
    return F.when(longest == 0, F.lit(100)).otherwise(F.round(F.lit(100.0) * (F.lit(1.0) - F.levenshtein(title, name) / longest)).cast("int"))


def _best(pairs: DataFrame) -> DataFrame:
    """(title, best): the highest similarity, then the smallest id."""
    return pairs.groupBy("title").agg(F.max(F.struct("similarity", (-F.col("id")).alias("minus_id"))).alias("best"))


def _edits(title: Column) -> Column:
    return F.least(F.lit(EDITS), F.floor(F.length(title) / SEGMENT).cast("int") - 1)


def _near(titles: DataFrame, names: DataFrame) -> DataFrame:
    """The best name within a few edits of each title. Of a title's edits + 1
    segments such a name holds one, shifted by no more than that."""
    n, edits = F.length("title"), F.col("edits")
    cut = lambda i: F.floor(i * n / (edits + 1)).cast("int")
    each = titles.withColumn("edits", _edits(F.col("title"))).where("edits > 0").select("title", "edits", F.explode(F.sequence(F.lit(0), edits)).alias("i"))
    segments = each.select(F.substring("title", cut(F.col("i")) + 1, cut(F.col("i") + 1) - cut(F.col("i"))).alias("segment"),
                           "title", "edits", (cut(F.col("i")) + 1).alias("place"))
    held = occurrences(names.select("id", "name", characters("name").alias("_chars")), "_chars", TermIndex(segments, "segment", by_words=False))
    pairs = held.where((F.abs(F.col("start") - F.col("place")) <= edits) & (F.abs(F.length("title") - F.length("name")) <= edits))
    return _best(pairs.select("title", "id", _score(F.col("title"), F.col("name")).alias("similarity")))


def _scan(titles: list[tuple[str, int]]):
    """For each task the best of its names for every (title, limit) that one of
    them reaches."""
    def run(batches):
        best = {}
        for names in batches:
            texts, ids = Texts(names["name"].tolist()), names["id"].to_numpy()
            size = names["name"].str.len().to_numpy()
            for title, limit in titles:
                limit = max(limit, best[title][0] if title in best else 0)
                n, share = len(title), (100.5 - limit) / 100  # edits are below this share of the longer one
                some, edits = texts.distances(title, int(n * (1 - share)) - 1, int(n / (1 - share)) + 1 if share < 1 else 2 ** 40)
                if not len(some):
                    continue
                longest = np.maximum(size[some], n)
                score = np.where(longest > 0, np.floor(100.0 * (1.0 - edits / np.maximum(longest, 1)) + 0.5), 100).astype(int)
                top = int(score.max())
                if top >= limit:
                    best[title] = max(best.get(title, (-1, 0)), (top, -int(ids[some[score == top]].min())))
        yield pd.DataFrame([(t, -i, s) for t, (s, i) in best.items()], columns=["title", "id", "similarity"]).astype(
            {"title": str, "id": "int64", "similarity": "int32"})
    return run


def _reaching(titles: DataFrame, names: DataFrame) -> DataFrame:
    """The best name of each title among those with a similarity of ``limit`` or
    more. A task reads its names once, against SENT_TITLES titles at a time, and
    returns one row a title at most."""
    found, sent = [], []

    def search():
        found.append(small_result(names.mapInPandas(_scan(sent), "title string, id bigint, similarity int")
                                  .groupBy("title").agg(F.max(F.struct("similarity", (-F.col("id")).alias("minus_id"))).alias("best"))))

    for r in titles.select("title", "limit").toLocalIterator():
        sent = [*sent, (r["title"], r["limit"])]
        if len(sent) == SENT_TITLES:
            search()
            sent = []
    if sent or not found:
        search()
    return reduce(DataFrame.unionByName, found)


def closest_title(queries: DataFrame, q_id: str, q_title: str, names: DataFrame, n_id: str, n_title: str) -> DataFrame:
    """For each query title the best of all names by similarity (ties by id), or
    nulls if the title is null or there is no name. Titles are compared with
    accents folded; equal names count once, with their smallest id.

    A segment index finds names within a few edits; a title whose best is so good
    that no name beyond these edits can reach it is done. The
    others get a first best from a bounded sample of names, and then meet all
    names in the tasks that hold them, with that best as the limit. No list of
    pairs grows with how common a word or a name is, and no pair leaves a task."""
    asked = small_result(queries.select(F.col(q_id).alias("_q"), tx.fold_accents(q_title).alias("title")))
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = cut_lineage(names.where(F.col(n_id).isNotNull() & F.col(n_title).isNotNull())
                        .groupBy(tx.fold_accents(n_title).alias("name")).agg(F.min(n_id).cast("bigint").alias("id"))
                        .repartition(tasks))  # few bytes, much work: not to be merged into a few tasks
    all_ = asked.where("title IS NOT NULL").select("title").distinct()
    best = small_result(_near(all_, known))
    # a name as good has at most so many edits, be it longer than the title or not
    share = (F.lit(100.5) - F.col("best.similarity")) / 100
    done = best.where((share < 1) & (share * F.length("title") / (1 - share) < _edits(F.col("title")) + 1)).select("title")
    left = small_result(all_.join(done, "title", "left_anti"))
    sample = small_result(known.orderBy(F.md5("name")).limit(SEEDS))
    first = small_result(_reaching(left.withColumn("limit", F.lit(0)), sample).unionByName(best).groupBy("title").agg(F.max("best").alias("best")))
    limited = left.join(first, "title").select("title", F.col("best.similarity").alias("limit"))
    every = first.unionByName(_reaching(limited, known)).groupBy("title").agg(F.max("best").alias("best"))
    return asked.join(every, "title", "left").select(F.col("_q").alias(q_id), (-F.col("best.minus_id")).cast(names.schema[n_id].dataType).alias(n_id), "best.similarity")


def shingles(tokens: Column, n: int = 3) -> Column:
    """Consecutive n-token sequences joined by a space."""
    def build(tk):
        idx = F.when(F.size(tk) >= n, F.sequence(F.lit(1), F.size(tk) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(idx, lambda i: F.array_join(F.slice(tk, i, n), " "))
    return tx.let(tokens, build)


def fragment_matches(fragments: DataFrame, frag_id: str, frag_tokens: str, docs: DataFrame, doc_id: str,
                     doc_tokens: str, n: int = 3) -> DataFrame:
    """(fragment, doc) pairs where the fragment's first n tokens occur
    consecutively in the document: an equi-join on n-token shingles."""
    f = fragments.where(F.size(frag_tokens) >= n).select(
        frag_id, F.array_join(F.slice(frag_tokens, 1, n), " ").alias("shingle"))
    d = docs.select(doc_id, F.explode(F.array_distinct(shingles(F.col(doc_tokens), n))).alias("shingle"))
    return d.join(f, "shingle").select(frag_id, doc_id).distinct()
