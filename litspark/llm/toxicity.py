"""Toxicity classifier with a counterfactual penalty.

A logistic model over the words of a text and their beginnings (hashed, present
or not). For every labelled text a twin is made in which a group term is
swapped for another of its kind ("jewish" for "muslim"); a text without a group
term has one added. The twin has the same label, so beside the log loss the squared change of the logit between text and twin is
penalised. A group's name thereby gets next to no weight of its own, and a
neutral mention does not raise the score.

Training takes at most ``TRAIN_ROWS`` labelled rows (a documented bound: those
with the smallest hash of their id) in one task, with numpy (adaptive steps,
soft-thresholded weights). Scoring reads every whole text in one pass without a shuffle.

Labels, language, source and ids are never inputs of a score.

Defined cases: null and empty texts score the model's constant; labels that are
null or neither 0 nor 1 are not learned from; with one class only every text
scores that share; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm.common import fold, slices, small_batches, table, text_of
from litspark.llm.features import bucket, distinct, sums, text_words
from litspark.llm.quality import trained_in_one_task, training_rows
from litspark.llm.words import ALPHANUMERIC, Words, mix, span_hashes, split_words

BUCKETS = 1 << 18
BEGINNINGS = (3, 4, 5, 6)
#: Passes over the labelled rows: at least EPOCHS, and enough for STEPS batches.
EPOCHS, STEPS = 8, 800
RATE = 0.15
BATCH = 64
#: Soft threshold of the weights: chance gradients shrink with the root of the rows.
SPARSE = 0.03
#: Weight of the counterfactual penalty.
TWIN = 0.5
TRAIN_ROWS = 6000
FOLDS, HELD_OUT = 5, 0

# Terms that name groups of people, by kind.
GROUP_TERMS = {
    "religion": "muslim muslims christian christians jewish jew jews hindu hindus buddhist catholic atheist islam musulman "
                "chrétien juif muslime christ jude katholisch musulmán cristiano judío católico",
    "gender": "woman women man men girl girls boy boys female male transgender femme femmes homme hommes frau frauen mann "
              "männer mujer mujeres hombre hombres",
    "orientation": "gay lesbian bisexual homosexual heterosexual queer straight lesbienne schwul lesbisch lesbiana",
    "origin": "black white asian african european american mexican latino arab chinese indian immigrant immigrants refugee "
              "refugees migrant noir blanc arabe immigré schwarz ausländer flüchtling negro blanco inmigrante refugiado",
    "body": "disabled blind deaf autistic old young elderly handicapé aveugle behindert blinde discapacitado ciego",
}


@dataclass
class Model:
    weight: np.ndarray
    bias: float


def _features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of the chosen words, where each word's begin): the word, and its
    beginnings of several lengths in bytes."""
    start, end = words.start[which], words.end[which]
    parts, owner = [bucket(span_hashes(words.data, start, end), BUCKETS)], [np.arange(len(which))]
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        parts.append(bucket(mix(span_hashes(words.data, start[long], start[long] + n) + np.uint64(n)), BUCKETS))
        owner.append(long)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(len(which) + 1))


def term_features() -> dict[str, list[tuple[int, np.ndarray]]]:
    """Per kind of group: (hash, features) of each term."""
    out = {}
    for kind, terms in GROUP_TERMS.items():
        words = text_words([terms], True)
        feats, first = _features(words, np.arange(len(words.start)))
        out[kind] = [(int(h), feats[a:b]) for h, a, b in zip(words.hashes().tolist(), first[:-1], first[1:])]
    return out


def _bags(data: np.ndarray, offsets: np.ndarray, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: its distinct features and the group terms in it (hashes)."""
    words = split_words(data, offsets, ALPHANUMERIC)
    hashes, place, number = distinct(words)
    feats, first = _features(words, place)
    named = np.isin(hashes, terms)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        own = np.unique(number[a:b])
        size = first[own + 1] - first[own]
        flat = feats[np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        yield np.unique(flat), hashes[own[named[own]]]


def train(bags: list[np.ndarray], named: list[np.ndarray], label: np.ndarray, twin: float = TWIN, seed: int = 1) -> Model:
    share = float(label.mean()) if len(label) else 0.5
    if not len(label) or not 0 < share < 1:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    kinds = list(term_features().values())
    home = {h: (k, i) for k, terms in enumerate(kinds) for i, (h, _) in enumerate(terms)}
    weight, bias = np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    seen, seen_bias = np.full(BUCKETS, 1e-4), 1e-4  # squared gradients so far
    size = np.array([len(x) for x in bags])
    sparse = SPARSE / len(label) ** 0.5
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(label)))):
        order = rng.permutation(len(label))
        for k in range(0, len(order), BATCH):
            which = order[k:k + BATCH]
            flat = np.concatenate([bags[i] for i in which])
            first = np.concatenate([[0], np.cumsum(size[which])])
            z = sums(weight[flat], first) + bias
            d = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label[which]
            grad = np.bincount(flat, weights=np.repeat(d, size[which]), minlength=BUCKETS)
            for i in which:  # the twin differs in the features of one word
                terms = [home[h] for h in named[i].view(np.uint64).tolist() if h in home]
                kind, old = terms[rng.integers(len(terms))] if terms else (int(rng.integers(len(kinds))), None)
                new = kinds[kind][rng.integers(len(kinds[kind]))][1]
                gone = kinds[kind][old][1] if old is not None else new[:0]
                change = weight[new].sum() - weight[gone].sum()
                np.add.at(grad, new, 2 * twin * change)
                np.add.at(grad, gone, -2 * twin * change)
            seen += grad * grad
            step = RATE / np.sqrt(seen)
            weight -= step * grad
            weight = np.sign(weight) * np.maximum(np.abs(weight) - step * sparse * len(which), 0)
            seen_bias += d.sum() ** 2
            bias -= RATE * d.sum() / np.sqrt(seen_bias)
    # Thresholding shrinks the weights; the constant is set anew so that a score
    # of 0.5 parts the training rows best (the middle of the best cuts).
    z = sums(weight[np.concatenate(bags)], np.concatenate([[0], np.cumsum(size)]))
    order = np.argsort(z, kind="stable")
    right = np.concatenate([[0], np.cumsum(1 - label[order])]) + np.concatenate([[0], np.cumsum(label[order][::-1])])[::-1]
    cuts = np.concatenate([[z[order[0]] - 1], (z[order][1:] + z[order][:-1]) / 2, [z[order[-1]] + 1]])
    right[1:-1][z[order][1:] == z[order][:-1]] = -1  # equal scores can't be parted
    best = cuts[right == right.max()]
    return Model(weight, -float((best[0] + best[-1]) / 2))


def _train_table(terms: np.ndarray, twin: float):
    def run(rows: pa.Table) -> list[np.ndarray]:
        parts = [part for batch, data, offsets in slices(iter(rows.to_batches()), "text") for part in _bags(data, offsets, terms)]
        model = train([index for index, _ in parts], [named.view(np.int64) for _, named in parts], rows["label"].to_numpy().astype(float), twin)
        return [model.weight, np.array([model.bias])]
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT,
        rows: int = TRAIN_ROWS, twin: float = TWIN) -> Model:
    small_batches(docs.sparkSession)
    terms = np.array(sorted(h for kind in term_features().values() for h, _ in kind), np.uint64)
    weight, bias = trained_in_one_task(training_rows(docs, labels, label, folds, held_out, False, rows), _train_table(terms, twin))
    return Model(weight, float(bias[0]))


def _scorer(model: Model):
    used = np.flatnonzero(model.weight)
    held = model.weight[used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(BUCKETS)
        weight[used] = held
        for batch, data, offsets in slices(batches, "text"):
            words = split_words(data, offsets, ALPHANUMERIC)
            _, place, number = distinct(words)
            feats, first = _features(words, place)
            # only features with a weight count, each once in a text
            heavy = weight[feats] != 0
            owner = np.repeat(np.arange(len(place)), np.diff(first))[heavy]
            kept, begin = feats[heavy], np.searchsorted(owner, np.arange(len(place) + 1))
            size = np.diff(begin)[number]
            flat = kept[np.repeat(begin[number] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            pair = np.unique(np.repeat(words.doc, size) * BUCKETS + flat)
            z = np.bincount(pair // BUCKETS, weights=weight[pair % BUCKETS], minlength=batch.num_rows) + model_bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    model_bias = model.bias
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row."""
    small_batches(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
            .mapInArrow(_scorer(model), "doc_id bigint, score double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL = None
