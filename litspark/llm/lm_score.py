"""Log probability of whole texts under a unigram model of subword pieces.

Pieces and their first weights come from an existing vocabulary; all
segmentations of a word count (``lattice``), so a text's score is its marginal
probability. From the corpus come the counts of all words of the training folds
(every distinct word, aggregated per task before the shuffle) and from them the
pieces' probabilities, by expectation maximisation over the table of words.

The word table grows with the corpus and is never broadcast. Its head, the most
frequent words, at most ``HEAD`` of them whatever the corpus, goes to every
task and settles most tokens of a text on the spot; the others are joined by
their hash and summed per text.

Defined cases: null and empty texts are the end token alone; an id repeated in
several rows gives a row for each; without training texts all counts are 0 and
the pieces keep their first weights; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm.common import SLICE_BYTES, checkpointed, fold, slices, small_batches, table, text_of
from litspark.llm.lattice import Pieces, expected_counts, log_probabilities, vocabulary
from litspark.llm.words import BLANK_SEPARATED, split_words

FOLDS, HELD_OUT = 10, 0
ADD = 0.1
ROUNDS = 2
#: Prior weight of the first guess, in pieces.
PRIOR = 1000.0
#: Frequent words that are shipped to every task at most.
HEAD = 300_000
#: Distinct words a task gathers before it hands them on.
GATHER = 1_000_000
#: Words whose lattices a task works on at a time.
WORDS = 20_000


@functools.cache
def _vocabulary(path: str) -> tuple[Pieces, np.ndarray]:
    return vocabulary(path)


class _Gathered:
    """Distinct words of a task with their counts."""

    def __init__(self):
        self.hash, self.count, self.text = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, hashes: np.ndarray, counts: np.ndarray, text_at) -> None:
        at = np.searchsorted(self.hash, hashes)
        old = np.zeros(len(hashes), bool)
        inside = at < len(self.hash)
        old[inside] = self.hash[at[inside]] == hashes[inside]
        self.count[at[old]] += counts[old]
        new = np.flatnonzero(~old)
        texts = np.empty(len(new), object)
        texts[:] = [text_at(i) for i in new.tolist()]
        self.hash, self.count = np.insert(self.hash, at[new], hashes[new]), np.insert(self.count, at[new], counts[new])
        self.text = np.insert(self.text, at[new], texts)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.hash), 20_000):
            s = slice(k, k + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(self.hash[s].view(np.int64)), pa.array(self.text[s].tolist(), pa.string()),
                                              pa.array(self.count[s])], ["h", "word", "c"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of all texts; only those of training texts are counted."""
    seen = _Gathered()
    for batch, data, offsets in slices(batches, "text"):
        words = split_words(data, offsets, BLANK_SEPARATED)
        hashes, place, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
        learn = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(float), words.counts)
        counts = np.bincount(number, weights=learn, minlength=len(hashes)).astype(np.int64)
        seen.add(hashes, counts, lambda i, w=words, p=place: w.text(p[i]))
        if len(seen.hash) > GATHER:
            yield from seen.batches()
            seen = _Gathered()
    yield from seen.batches()


def word_table(docs: DataFrame) -> DataFrame:
    """(h, word, c) of every distinct word of ``docs`` (text, learn)."""
    return docs.mapInArrow(_count_words, "h bigint, word string, c bigint").groupBy("h", "word").agg(F.sum("c").alias("c"))


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold WORDS rows or SLICE_BYTES bytes:
    words of a length are worked on together."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= WORDS or size >= SLICE_BYTES:
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def fit(words: DataFrame, end_count: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities (natural) of the pieces, the bytes and the end."""
    pieces, first = _vocabulary(path)
    logp = np.log(first)
    for _ in range(rounds):
        def expect(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            pieces, _ = _vocabulary(path)
            total = np.zeros(pieces.size)
            for batch in _many(batches):
                total += expected_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float), pieces, logp)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["piece", "times"])

        got = (words.filter("c > 0").select("word", "c").mapInArrow(expect, "piece int, times double")
               .groupBy("piece").agg(F.sum("times").alias("times")).toArrow())  # at most one row per piece
        times = np.zeros(pieces.size)
        times[got["piece"].to_numpy()] = got["times"].to_numpy()
        times[pieces.end] = end_count
        share = times + PRIOR * first
        logp = np.log(share / share.sum())
    return logp


def scored_words(words: DataFrame, logp: np.ndarray, path: str, total: int, distinct: int) -> DataFrame:
    """(h, c, known, base, score): what one occurrence adds, in log10."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = _vocabulary(path)
        for batch in _many(batches):
            c = batch.column(2).to_numpy(zero_copy_only=False)
            score = log_probabilities(batch.column(1).to_pylist(), pieces, logp) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array((c > 0).astype(np.int64)),
                                              pa.array(np.log10((c + ADD) / (total + ADD * (distinct + 1)))), pa.array(score)],
                                             ["h", "c", "known", "base", "score"])
    return words.select("h", "word", "c").mapInArrow(run, "h bigint, c bigint, known bigint, base double, score double")


def _head(table_: DataFrame) -> tuple[np.ndarray, ...]:
    """The most frequent words, at most HEAD, chosen by a count that few enough reach."""
    sizes = table_.groupBy(F.floor(F.log2(F.col("c") + 1) * 8).alias("level")).count().collect()  # a few hundred rows
    least, held = None, 0
    for level, n in sorted(((r["level"], r["count"]) for r in sizes), reverse=True):
        if held + n > HEAD:
            break
        least, held = level, held + n
    if least is None:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    got = table_.filter(F.floor(F.log2(F.col("c") + 1) * 8) >= least).select("h", "known", "base", "score").toArrow()
    h = got["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], *(got[n].to_numpy()[order] for n in ("known", "base", "score"))


def _settle(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text a row (h null) with what the frequent words add, and a row
        per other distinct word with its number of occurrences."""
        hashes, known, base, score = head.value
        row = TaskContext.get().partitionId() << 40
        for batch, data, offsets in slices(batches, "text"):
            words = split_words(data, offsets, BLANK_SEPARATED)
            n = batch.num_rows
            h, doc = words.hashes(), words.doc
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            held = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
            add = [np.bincount(doc[held], weights=x[at[held]], minlength=n).astype(float) for x in (known, base, score)]
            rest, times = np.unique(np.stack([doc[~held].astype(np.uint64), h[~held]], 1), axis=0, return_counts=True) if (~held).any() else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
            ids = batch.column(0)
            numbers = row + np.arange(n)
            k = len(rest)
            none = pa.nulls(k, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(numbers), pa.array(numbers[rest[:, 0].astype(np.int64)])]),
                 pa.concat_arrays([ids, pa.nulls(k, pa.int64())]),
                 pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(rest[:, 1].copy().view(np.int64))]),
                 pa.concat_arrays([pa.array(words.counts + 1), pa.array(times.astype(np.int64))]),
                 *(pa.concat_arrays([pa.array(x), none]) for x in add)],
                ["row", "doc_id", "h", "n", "known", "base", "score"])
            row += n
    return run


_SETTLED = "row bigint, doc_id bigint, h bigint, n bigint, known double, base double, score double"


def score(docs: DataFrame, learn, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score,
    score. ``learn``: column that is true for the texts to learn from."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), learn.alias("learn"), text_of().alias("text"))
    words = checkpointed(word_table(texts))
    train_texts = texts.filter("learn").count()
    total, distinct = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + train_texts, distinct + (train_texts > 0)
    logp = fit(words, train_texts, path)
    scored = checkpointed(scored_words(words, logp, path, total, distinct))
    head = spark.sparkContext.broadcast(_head(scored))  # at most HEAD words
    settled = checkpointed(texts.select("doc_id", "text").mapInArrow(_settle(head), _SETTLED))
    rest = (settled.filter("h is not null").select("row", "h", "n").join(scored.select("h", "known", "base", "score"), "h")
            .groupBy("row").agg(*[F.sum(F.col(c) * F.col("n")).alias(c) for c in ("known", "base", "score")]))
    own = settled.filter("h is null").select("row", "doc_id", "n", "known", "base", "score")
    r = rest.toDF("row", "known_", "base_", "score_")
    pieces, _ = _vocabulary(path)
    end_base = math.log10((train_texts + ADD) / (total + ADD * (distinct + 1)))
    both = own.join(r, "row", "left")
    plus = lambda c: F.col(c) + F.coalesce(F.col(c + "_"), F.lit(0.0))
    return both.select("doc_id", F.col("n").alias("n_tokens"), (plus("known") + int(train_texts > 0)).cast("bigint").alias("n_known"),
                       F.lit(total).cast("bigint").alias("train_tokens"), (plus("base") + end_base).alias("base_score"),
                       (plus("score") + float(logp[pieces.end] / math.log(10))).alias("score"))


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return score(docs, ~held_out, default_vocabulary()).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


SQL = None
