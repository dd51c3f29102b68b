"""Quality classifier on supervised subword embeddings.

Every word, character n-gram and word repetition is hashed to a row of a learned table; a
document is the average of the rows of all its features, and a softmax layer on
top gives the class. Table and layer are trained together by plain stochastic
gradient descent in numpy, with a learning rate that falls to zero.

Training takes labelled rows only, at most ``TRAIN_ROWS`` of them (those with
the smallest hash of their id: a documented bound, every label of a smaller
corpus is used). One task trains on them, in an order that does not depend on the
files, and the driver receives the model alone. Scoring reads every whole text:
the table and the layer collapse to one number per feature, so a word costs one
look-up, and nothing is shuffled.

Labels, language, source and ids are never inputs of a score.

Defined cases: null and empty texts have the constant feature only and get the
score of it; labels that are null or neither 0 nor 1 are not learned from; ids
repeated among the labels count once each, of documents that share an id the
least text is learned from; without both classes every
text scores the share of label 1 (0.5 without labels); an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm.common import fold, slices, small_batches, table, text_of
from litspark.llm.features import Bags, distinct, sums, word_features
from litspark.llm.words import BLANK_SEPARATED, Words, split_words

BUCKETS = 1 << 15
NGRAMS = (3, 4)
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.5
BATCH = 32
#: A feature's share of a text is small; its row moves that much faster.
GAIN = 20.0
#: Labelled rows that training takes at most.
TRAIN_ROWS = 3000
FOLDS, HELD_OUT = 3, 1


@dataclass
class Model:
    feature: np.ndarray   # logit contribution of each feature, times its share of the text
    always: float         # of the constant feature
    bias: float


def _repeats(words: Words, number: np.ndarray) -> np.ndarray:
    """Word n-grams are hashed by how their words differ: a word equal to the
    one before, or to the one before that, is a feature whatever the word."""
    doc = words.doc
    out = np.zeros((2, len(number)), np.int64)
    for k in (1, 2):
        out[k - 1, k:] = (number[k:] == number[:-k]) & (doc[k:] == doc[:-k])
    return out


def _bags_of_slice(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per text: (number of features, distinct features, their counts)."""
    words = split_words(data, offsets, BLANK_SEPARATED, lower=False)
    _, place, number = distinct(words)
    feats, first = word_features(words, place, NGRAMS, BUCKETS)
    again = _repeats(words, number)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        own, times = np.unique(number[a:b], return_counts=True)
        size = first[own + 1] - first[own]
        flat = feats[np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        counts = np.bincount(flat, weights=np.repeat(times, size), minlength=BUCKETS + 2) if len(flat) else np.zeros(BUCKETS + 2)
        counts[BUCKETS:] = np.add.reduceat(again[:, a:b], [0], axis=1)[:, 0] if b > a else 0
        hit = np.flatnonzero(counts)
        yield int(counts.sum()), hit, counts[hit]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, learn_held_out: bool, rows: int) -> DataFrame:
    """(key, label, text) of at most ``rows`` labelled documents of the training
    folds; ``key`` (of id, label and text) orders them whatever the files are. Of
    documents that share an id the least text is taken, so copies of an id add no
    row. ``learn_held_out``: whether ``held_out`` names the fold left out (False)
    or the only fold used."""
    l = labels.select(F.col("doc_id").alias("id_"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    own = fold(F.col("id_"), folds) == held_out
    chosen = (l.filter(own if learn_held_out else ~own).distinct()
              .orderBy(F.xxhash64("id_", F.lit(5)), "id_", "label").limit(rows))
    found = docs.select(F.col("doc_id").alias("id_"), text_of().alias("text")).join(F.broadcast(chosen), "id_")
    return (found.groupBy("id_", "label").agg(F.min("text").alias("text"))
            .select(F.xxhash64("id_", "label", "text").alias("key"), "label", "text"))


def trained_in_one_task(rows: DataFrame, train_batch: Callable[[pa.Table], list[np.ndarray]]) -> list[np.ndarray]:
    """Train on a bounded number of (key, label, text) rows in a single task and
    return the arrays of the model: the driver holds neither texts nor features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        found = train_batch((pa.Table.from_batches(held) if held else schema.empty_table()).sort_by([("key", "ascending"), ("label", "ascending")]))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array([x.ravel().tolist() for x in found], pa.list_(pa.float64()))],
                                         ["at", "x"])

    schema = pa.schema([("key", pa.int64()), ("label", pa.int32()), ("text", pa.string())])
    model = sorted(rows.coalesce(1).mapInArrow(run, "at int, x array<double>").collect(), key=lambda r: r["at"])
    return [np.array(r["x"]) for r in model] or train_batch(schema.empty_table())  # without rows there may be no task


def train(bags: Bags, label: np.ndarray, seed: int = 1) -> Model:
    positive = float(label.mean()) if len(label) else 0.5
    if not len(label) or not 0 < positive < 1:
        p = min(max(positive, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS + 2), 0.0, float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    # the last row is the constant feature, which every text has once
    rows = rng.uniform(-1, 1, (BUCKETS + 3, DIMENSIONS)) / DIMENSIONS
    out, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    target = np.stack([1 - label, label], 1).astype(float)
    steps = EPOCHS * -(-len(label) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for k in range(0, len(order), BATCH):
            which = order[k:k + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            b = bags.rows(which)
            mean = sums(rows[b.index] * b.weight[:, None], b.first) + rows[-1]
            score = mean @ out + bias
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = p - target[which]
            back = d @ out.T
            out -= rate * (mean.T @ d)
            bias -= rate * d.sum(0) / BATCH
            rows[-1] -= rate * back.sum(0) / BATCH
            flat = back[np.repeat(np.arange(len(which)), np.diff(b.first))] * b.weight[:, None]
            # a feature's row moves with its share of the text; scaled up, since shares are small
            for c in range(DIMENSIONS):
                rows[:-1, c] -= rate * GAIN * np.bincount(b.index, weights=flat[:, c], minlength=BUCKETS + 2)
    apart = out[:, 1] - out[:, 0]
    return Model(rows[:-1] @ apart, float(rows[-1] @ apart), float(bias[1] - bias[0]))


def _train_table(rows: pa.Table) -> list[np.ndarray]:
    parts = [part for batch, data, offsets in slices(iter(rows.to_batches()), "text") for part in _bags_of_slice(data, offsets)]
    size = np.array([len(index) for _, index, _ in parts], np.int64)
    bags = Bags(np.concatenate([index for _, index, _ in parts] or [np.zeros(0)]).astype(np.int64),
                np.concatenate([count / max(total, 1) for total, _, count in parts] or [np.zeros(0)]),
                np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
    model = train(bags, rows["label"].to_numpy().astype(int))
    return [model.feature, np.array([model.always, model.bias])]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT,
        learn_held_out: bool = False, rows: int = TRAIN_ROWS) -> Model:
    small_batches(docs.sparkSession)
    feature, (always, bias) = trained_in_one_task(training_rows(docs, labels, label, folds, held_out, learn_held_out, rows), _train_table)
    return Model(feature, float(always), float(bias))


def _scores(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    words = split_words(data, offsets, BLANK_SEPARATED, lower=False)
    _, place, number = distinct(words)
    feats, first = word_features(words, place, NGRAMS, BUCKETS)
    of_word, size = sums(model.feature[feats], first), np.diff(first)
    again = _repeats(words, number)
    total = sums((size[number] + again.sum(0)).astype(float), words.first)
    in_text = of_word[number] + model.feature[BUCKETS:] @ again
    logit = sums(in_text, words.first) / np.maximum(total, 1) + model.always + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(data, offsets, model))], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
            .mapInArrow(run, "doc_id bigint, score double"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored below the threshold, all columns kept;
    each row is decided where it is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            yield batch.filter(pa.array(_scores(data, offsets, model) >= threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL = None
