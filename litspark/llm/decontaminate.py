"""Benchmark passages in training texts, by suffix arrays over the training side.

A shard is a slice of a partition's documents. Its word sequence is sorted into
a suffix array (of all suffixes that can match at all: those that begin with
enough words of the benchmark's vocabulary). Every suffix of the test items is
then searched in the sorted array by binary search; the hits are the locations
in the shard where at least a window matches, and each is extended to its
longest verbatim match. Shards are independent, so a lost executor only costs
its shards again, and a passage shared by many documents costs each of them its
own match and nothing else.

The test side is the stated query set. It is shipped to the tasks in blocks of
at most ``BLOCK_WORDS`` words, however many items there are; with several blocks
the documents are numbered once and the blocks' results united by that number.

Defined cases: null and empty texts have no words and match nothing; items
without words are left out; a null item_id never appears in a list; repeated
items and documents are treated row by row; an empty table gives no matches;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm.common import checkpointed, slices, small_batches, table, text_of, utf8
from litspark.llm.words import ALPHANUMERIC, Words, split_words

WINDOW = 10
#: Words of test items that one task holds at a time.
BLOCK_WORDS = 2_000_000


class TestBlock:
    """Test items as sequences of vocabulary numbers (1, 2, ...) and the sorted
    table of their distinct windows. Items shorter than a window are a window
    of their own."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        data, offsets = utf8(pa.array(texts, pa.string()))
        words = split_words(data, offsets, ALPHANUMERIC)
        self.ids, self.window = ids, window
        self.vocabulary, numbers = np.unique(words.hashes(), return_inverse=True)
        self.items = [numbers[a:b].astype(np.int32) + 1 for a, b in zip(words.first[:-1], words.first[1:])]
        self.flat = np.concatenate([*self.items, np.zeros(1, np.int32)]) if self.items else np.zeros(1, np.int32)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in self.items])]).astype(np.int64)
        self.shortest = min([min(len(x), window) for x in self.items if len(x)], default=0)
        # (length, item, position in the item) of every window
        spots: dict[int, list[tuple[int, int]]] = {}
        for i, x in enumerate(self.items):
            if len(x):
                size = min(len(x), window)
                spots.setdefault(size, []).extend((i, p) for p in range(len(x) - size + 1))
        self.spots = {size: np.array(v, np.int64) for size, v in spots.items()}

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of hashed words, 0 for words outside."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


def _keys(sequence: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` numbers from each position as one big-endian byte string:
    strings compare as the number sequences do."""
    rows = sequence[at[:, None] + np.arange(size)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * size}").ravel()


def suffix_array(sequence: np.ndarray, run: np.ndarray, depth: int) -> np.ndarray:
    """Positions with at least ``depth`` usable words ahead, sorted by them."""
    at = np.flatnonzero(run >= depth)
    return at[np.argsort(_keys(sequence, at, depth), kind="stable")]


def shard_matches(block: TestBlock, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, item position, shard position, length) of the longest match from
    every location where a test suffix matches at least a window."""
    n = len(numbers)
    # usable words ahead of each position, inside its document
    unknown = np.append(np.flatnonzero(numbers == 0), n)
    run = np.minimum(unknown[np.searchsorted(unknown, np.arange(n))], np.repeat(first[1:], np.diff(first))) - np.arange(n)
    found = []
    for size, spots in block.spots.items():
        order = suffix_array(numbers, run, size)
        if not len(order):
            continue
        keys = _keys(numbers, order, size)
        tests = _keys(block.flat, block.first[spots[:, 0]] + spots[:, 1], size)
        low, high = np.searchsorted(keys, tests, "left"), np.searchsorted(keys, tests, "right")
        many = high - low
        hit = np.flatnonzero(many)
        if not len(hit):
            continue
        which = np.repeat(hit, many[hit])
        inside = np.arange(len(which)) - np.repeat(np.cumsum(many[hit]) - many[hit], many[hit])
        found.append((spots[which, 0], spots[which, 1], order[low[which] + inside], np.full(len(which), size)))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    item, place, where, size = (np.concatenate(x) for x in zip(*found))
    left = np.minimum(run[where], np.diff(block.first)[item] - place)
    length, active = size.copy(), np.flatnonzero(size < left)
    while len(active):
        same = numbers[where[active] + length[active]] == block.flat[block.first[item[active]] + place[active] + length[active]]
        active = active[same]
        length[active] += 1
        active = active[length[active] < left[active]]
    return item, place, where, length


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[TestBlock]:
    """The test items in blocks, in whatever order they arrive."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), text_of(text_col).alias("t")).toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"].split()) + 1
        if size >= BLOCK_WORDS:
            yield TestBlock(ids, texts, window)
            ids, texts, size = [], [], 0
    yield TestBlock(ids, texts, window)


def _scanner(block: TestBlock):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            words = split_words(data, offsets, ALPHANUMERIC)
            numbers = _numbers(block, words)
            item, _, where, length = shard_matches(block, numbers, words.first)
            hits = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(hits, where, 1)
            np.add.at(hits, where + length, -1)
            hit = np.cumsum(hits)[:-1] > 0
            doc = np.searchsorted(words.first, where, side="right") - 1
            found: dict[int, set] = {}
            for d, i in np.unique(np.stack([doc, item], 1), axis=0).tolist() if len(doc) else []:
                found.setdefault(d, set()).add(block.ids[i])
            starts = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]) | hit & np.isin(np.arange(len(hit)), words.first))
            spans: dict[int, list] = {}
            for d, s in zip((np.searchsorted(words.first, starts, side="right") - 1).tolist(), starts.tolist()):
                stop = min(int(words.first[d + 1]), s + int(np.argmin(np.append(hit[s:words.first[d + 1]], False))))
                spans.setdefault(d, []).append({"start": s - int(words.first[d]), "words": stop - s})
            longest = np.zeros(batch.num_rows, np.int64)
            np.maximum.at(longest, doc, length)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words.counts, pa.int64()),
                 pa.array([spans.get(d, []) for d in range(batch.num_rows)], pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))),
                 pa.array([sorted(x for x in found.get(d, ()) if x is not None) for d in range(batch.num_rows)], pa.list_(pa.string())),
                 pa.array(longest)], ["row", "doc_id", "n_words", "spans", "items", "longest"])
    return run


_SCHEMA = "row bigint, doc_id bigint, n_words bigint, spans array<struct<start:bigint,words:bigint>>, items array<string>, longest bigint"


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (word start and number of
    words of the merged matches), items (ids, sorted as text), longest match."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    blocks = _blocks(benchmark, "item_id", "text", window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return rows.mapInArrow(_scanner(first), _SCHEMA).drop("row")
    rows = checkpointed(rows)  # a row has the same number in every block
    out = checkpointed(rows.mapInArrow(_scanner(first), _SCHEMA))  # written before the next block is read:
    for block in chain([second], blocks):  # the driver holds one at a time
        out = out.unionByName(checkpointed(rows.mapInArrow(_scanner(block), _SCHEMA).filter("longest > 0")))
    merged = out.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    return merged.mapInArrow(_united, _SCHEMA).drop("row")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks that overlap or touch become one, as in one block."""
    for batch in batches:
        at = batch.schema.get_field_index("spans")
        lists = batch.column(at)
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        start, words = (x.to_numpy() for x in lists.flatten().flatten())
        base = owner * (int((start + words).max(initial=0)) + 1)  # no span reaches the next row
        order = np.argsort(start + base, kind="stable")
        begin, reach = (start + base)[order], np.maximum.accumulate((start + words + base)[order])
        first = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]])[:len(begin)])
        last = np.append(first[1:], len(begin))[:len(first)] - 1
        spans = pa.StructArray.from_arrays([pa.array(start[order][first], pa.int64()), pa.array(reach[last] - begin[first], pa.int64())], ["start", "words"])
        offsets = pa.array(np.searchsorted(owner[order][first], np.arange(len(lists) + 1)), pa.int32())
        yield batch.set_column(at, "spans", pa.ListArray.from_arrays(offsets, spans))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a test window, all columns kept;
    each row is decided where it is read, block by block of the test items."""
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, "item_id", "text", window)
    clean = docs.mapInArrow(_cleaner(next(blocks)), docs.schema)
    for block in blocks:  # what is left is written first: the driver holds one block at a time
        clean = checkpointed(clean).mapInArrow(_cleaner(block), docs.schema)
    return clean


def _cleaner(block: TestBlock):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            words = split_words(data, offsets, ALPHANUMERIC)
            _, _, where, _ = shard_matches(block, _numbers(block, words), words.first)
            clean = np.ones(batch.num_rows, bool)
            clean[np.searchsorted(words.first, where, side="right") - 1] = False
            yield batch.filter(pa.array(clean))
    return run


def _numbers(block: TestBlock, words: Words) -> np.ndarray:
    return block.numbers(words.hashes()) if len(block.vocabulary) else np.zeros(len(words.start), np.int32)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["words"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sizes AS (SELECT DISTINCT least(len(words), 10) AS size FROM b WHERE len(words) > 0),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(words[p:p + size - 1], ' ') AS gram
  FROM (SELECT item_id, words, least(len(words), 10) AS size,
               unnest(range(1, len(words) - least(len(words), 10) + 2)) AS p FROM b WHERE len(words) > 0)),
dw AS (
  SELECT doc_id, size, p, array_to_string(words[p:p + size - 1], ' ') AS gram
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM w, sizes WHERE len(words) >= size)),
found AS (SELECT dw.doc_id, dw.p, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.gram = bw.gram),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM found)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
