"""Ranked lexical search with hashed max-sketches.

Every term of a document has an impact (its saturated frequency at the
document's length). All impacts of a document fold into a sketch of
``COORDINATES`` numbers, each the largest impact of the terms hashed there. The
weights of a query's terms, summed by the same coordinates, times a sketch are
an upper bound of the document's score: a term that the document has is counted
with its impact or more, any other with zero or more. A batch of sketches meets
all queries of a block in one matrix product.

Documents are rescored exactly in descending order of their bounds until the
bound falls below the k-th best exact score that the task has found. Ties are
rescored too, so nothing is missed. A task returns k rows a query at most, which
meet in two rounds (first per group of tasks), so no task sees the rows of all.

Statistics (documents, terms, in how many documents a query's term is) come from
a pass before, over all documents. Queries are read in blocks of at most
``BLOCK_ITEMS`` items or ``BLOCK_TERMS`` terms (or one item with more): the
driver and every task hold one block at a time, and the result of a block is
written before the next one is read.

Terms are runs of ASCII letters and digits and of any other characters beyond
ASCII, with A-Z lower-cased. Inside a document they are told apart by a 64-bit
hash, and are matched with a query's by two of them.

Defined cases: null and empty texts have no term, such an item has no rows;
repeated documents are ranked one by one, and so are repeated items; a null
doc_id comes behind the others of its score; without any term in the documents
there are no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark.llm.common import checkpointed, shared_folder, slices, small_batches, table, text_of
from litspark.llm.words import ALPHANUMERIC, Words, span_hashes, split_words

K = 10
COORDINATES = 1024
BLOCK_ITEMS = 256
BLOCK_TERMS = 100_000
#: Documents of a batch that a query rescores before it looks at its threshold again.
CHUNK = 8
#: Groups of tasks whose rows meet first.
GROUPS = 64
_OTHER = np.uint8(0x5A)


def _second(words: Words, of: np.ndarray) -> np.ndarray:
    """A second hash of some words: the first one's of all bytes changed."""
    return span_hashes(words.data ^ _OTHER, words.start[of], words.end[of])


@dataclass
class Block:
    """Some items and their distinct terms. Term i has hashes ``h1[i]``
    (increasing) and ``h2[i]``; item q's terms are ``term[first[q]:first[q+1]]``,
    increasing."""
    number: np.ndarray
    item_id: list
    h1: np.ndarray
    h2: np.ndarray
    term: np.ndarray
    first: np.ndarray
    weight: np.ndarray | None = None  # of each term

    @staticmethod
    def of(rows: list[tuple[int, int | None, np.ndarray, np.ndarray]]) -> Block:
        h1, h2 = (np.concatenate([r[k] for r in rows]).astype(np.int64).view(np.uint64) for k in (2, 3))
        both, term = np.unique(np.stack([h1, h2], 1), axis=0, return_inverse=True)
        size = [len(r[2]) for r in rows]
        first = np.concatenate([[0], np.cumsum(size)])
        term = term.reshape(-1)
        term = term[np.lexsort((term, np.repeat(np.arange(len(rows)), size)))]
        return Block(np.array([r[0] for r in rows]), [r[1] for r in rows], both[:, 0], both[:, 1], term, first)

    def find(self, h1: np.ndarray) -> np.ndarray:
        """The first term with each hash, or -1."""
        if not len(self.h1):
            return np.full(len(h1), -1)
        at = np.searchsorted(self.h1, h1)
        at[at == len(self.h1)] = 0
        return np.where(self.h1[at] == h1, at, -1)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each item's distinct terms."""
    for batch, data, offsets in slices(batches, "text"):
        words = split_words(data, offsets, ALPHANUMERIC)
        h1, h2 = words.hashes(), _second(words, np.arange(len(words.start)))
        lists: tuple[list, list] = ([], [])
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            both = np.unique(np.stack([h1[a:b], h2[a:b]], 1), axis=0).view(np.int64)
            lists[0].append(both[:, 0])
            lists[1].append(both[:, 1])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["item_id", "h1", "h2"])


def blocks(items: DataFrame) -> Iterator[Block]:
    """The items in blocks, one after the other; items are numbered as they come."""
    terms = checkpointed(items.select(F.col("item_id").cast("bigint").alias("item_id"), text_of().alias("text"))
                         .mapInArrow(_item_terms, "item_id bigint, h1 array<bigint>, h2 array<bigint>"))
    rows, size = [], 0
    for number, r in enumerate(terms.toLocalIterator()):
        h1, h2 = np.array(r.h1, np.int64), np.array(r.h2, np.int64)
        if rows and (len(rows) == BLOCK_ITEMS or size + len(h1) > BLOCK_TERMS):
            yield Block.of(rows)
            rows, size = [], 0
        rows.append((number, r.item_id, h1, h2))
        size += len(h1)
    if rows:
        yield Block.of(rows)


def _frequencies(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text: text, hash, occurrences and one of the words."""
    h, doc = words.hashes(), words.doc
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16 if len(words.first) < 65536 else np.int64), kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff([*at, len(h)]) if len(at) else at, order[at]


def _matched(block: Block, words: Words, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the distinct terms are terms of the block, and which ones."""
    term = block.find(h)
    at = np.flatnonzero(term >= 0)
    term = term[at]
    second = _second(words, of[at])
    while True:  # terms with an equal first hash stand side by side
        other = np.flatnonzero(block.h2[term] != second)
        onward = term[other] + 1
        onward = (onward < len(block.h1)) & (block.h1[np.minimum(onward, len(block.h1) - 1)] == h[at[other]])
        term[other[onward]] += 1
        if not onward.any():
            break
    same = block.h2[term] == second
    return at[same], term[same]


def _counting(block: Block):
    """For each task: how many documents have a term (-1), all terms (-2), and
    the documents that have each of the block's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, terms = np.zeros(len(block.h1), np.int64), 0, 0
        for _, data, offsets in slices(batches, "text"):
            words = split_words(data, offsets, ALPHANUMERIC)
            _, h, _, of = _frequencies(words)
            docs, terms = docs + int((words.counts > 0).sum()), terms + len(words.start)
            held += np.bincount(_matched(block, words, h, of)[1], minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int64()),
                                          pa.array([docs, terms, *held[some].tolist()], pa.int64())], ["key", "n"])
    return run


def weighted(block: Block, docs: DataFrame) -> tuple[int, int]:
    """Give the block's terms their weights; documents with a term and terms."""
    found = docs.mapInArrow(_counting(block), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    n = {r["key"]: r["n"] for r in found.collect()}  # a row per term of the block
    many = n.get(-1, 0)
    block.weight = np.array([math.floor(1000 * math.log((2 * many + 2) / (2 * n.get(t, 0) + 1))) for t in range(len(block.h1))], np.int64)
    return many, n.get(-2, 0)


class Best:
    """The k best documents of every item so far, in order."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.id = np.zeros((items, k), np.int64)
        self.null = np.zeros((items, k), bool)

    @property
    def least(self) -> np.ndarray:
        """What a score must reach to enter."""
        return np.maximum(self.score[:, -1], 1)

    def add(self, item: np.ndarray, score: np.ndarray, doc_id: np.ndarray, null: np.ndarray) -> None:
        order = np.argsort(item, kind="stable")
        item, score, doc_id, null = item[order], score[order], doc_id[order], null[order]
        own, at = np.unique(item, return_index=True)
        for q, a, b in zip(own.tolist(), at.tolist(), [*at[1:].tolist(), len(item)]):
            s = np.concatenate([self.score[q], score[a:b]])
            d, x = np.concatenate([self.id[q], doc_id[a:b]]), np.concatenate([self.null[q], null[a:b]])
            first = np.lexsort((d, x, -s))[:self.k]
            self.score[q], self.id[q], self.null[q] = s[first], d[first], x[first]


class Scorer:
    """Sketches, bounds and exact scores of batches of documents."""

    def __init__(self, block: Block, docs: int, terms: int, coordinates: int):
        self.block, self.docs, self.terms, self.coordinates = block, docs, terms, coordinates
        self.item = np.repeat(np.arange(len(block.item_id)), np.diff(block.first))
        self.folded = np.zeros((coordinates, len(block.item_id)))
        np.add.at(self.folded, (self._coordinate(block.h1[block.term]), self.item), block.weight[block.term].astype(float))

    def _coordinate(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.coordinates)).astype(np.int64)

    def load(self, words: Words) -> np.ndarray:
        """Take a batch; bounds of all (document, item) pairs."""
        n = words.counts.astype(np.int64)
        m = 10 + (90 * n * self.docs) // max(self.terms, 1)
        doc, h, tf, of = _frequencies(words)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        sketch = np.zeros(len(n) * self.coordinates, np.int64)
        np.maximum.at(sketch, doc * self.coordinates + self._coordinate(h), impact)
        at, term = _matched(self.block, words, h, of)
        key = doc[at] * len(self.block.h1) + term
        order = np.argsort(key)
        self.key, self.impact = key[order], impact[at][order]
        # products of whole numbers, exact below 2^53; the factor covers longer items
        return sketch.reshape(len(n), -1).astype(float) @ self.folded * (1 + 1e-12)

    def exact(self, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Scores of pairs."""
        out, first = np.zeros(len(doc), np.int64), self.block.first
        if not len(self.key):
            return out
        for a in range(0, len(doc), 4096):
            d, q = doc[a:a + 4096], item[a:a + 4096]
            size = first[q + 1] - first[q]
            pair = np.repeat(np.arange(len(d)), size)
            term = self.block.term[np.repeat(first[q] - (np.cumsum(size) - size), size) + np.arange(len(pair))]
            key = d[pair] * len(self.block.h1) + term
            at = np.searchsorted(self.key, key)
            at[at == len(self.key)] = 0
            hit = np.flatnonzero(self.key[at] == key)
            np.add.at(out, a + pair[hit], self.block.weight[term[hit]] * self.impact[at[hit]])
        return out


def rescored(scorer: Scorer, best: Best, words: Words, doc_id: np.ndarray, null: np.ndarray) -> int:
    """Enter a batch's documents into ``best``; how many pairs were rescored."""
    bound = scorer.load(words)
    left, done, chunk = bound >= best.least, 0, CHUNK
    while left.any():
        rest = np.where(left, bound, -1.0)
        if chunk < len(rest):  # of every item the documents with the largest bounds
            take = left & (rest >= np.partition(rest, len(rest) - chunk, axis=0)[len(rest) - chunk])
        else:
            take = left
        d, q = np.nonzero(take)
        score = scorer.exact(d, q)
        good = score >= best.least[q]
        best.add(q[good], score[good], doc_id[d[good]], null[d[good]])
        done, chunk = done + len(d), 2 * chunk
        left &= ~take & (bound >= best.least)
    return done


def _searching(block: Block, docs: int, terms: int, k: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, best = Scorer(block, docs, terms, coordinates), Best(len(block.item_id), k)
        for batch, data, offsets in slices(batches, "text"):
            column = batch.column(0)
            rescored(scorer, best, split_words(data, offsets, ALPHANUMERIC), column.fill_null(0).to_numpy(zero_copy_only=False),
                     column.is_null().to_numpy(zero_copy_only=False))
        q, at = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.number[q], pa.int64()), pa.array([block.item_id[i] for i in q.tolist()], pa.int64()),
             pa.array(best.id[q, at], pa.int64(), mask=best.null[q, at]), pa.array(best.score[q, at], pa.int64())], list(_FOUND))
    return run


_FOUND = ("number", "item_id", "doc_id", "score")


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, coordinates: int = COORDINATES) -> DataFrame:
    """The ``k`` best documents of every item with a score above 0: item_id,
    rank, doc_id, score. Equal scores stand by doc_id."""
    spark = docs.sparkSession
    shared_folder(spark)
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in blocks(items):
        many, terms = weighted(block, texts.select("text"))
        rows = texts.mapInArrow(_searching(block, many, terms, k, coordinates), ", ".join(f"{n} bigint" for n in _FOUND))
        near = _first(rows.withColumn("group", F.spark_partition_id() % GROUPS), k, "number", "group").drop("rank")
        ranked = _first(near, k, "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = out.unionByName(checkpointed(ranked))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[0-9a-z\x{80}-\x{10FFFF}]+')")
SQL = f"""
WITH tf AS (SELECT doc_id, w, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS w FROM documents) GROUP BY doc_id, w),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
held AS (SELECT w, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY w),
asked AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest({_TERMS}) AS w FROM benchmark)),
scored AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT)
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
           FROM asked JOIN tf USING (w) JOIN held USING (w) JOIN size USING (doc_id) CROSS JOIN total GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {K}
"""
