"""Hashed subword features of whole texts.

A word's features are itself and its character n-grams (with marks at both
ends), each hashed into one of ``BUCKETS`` rows of a learned table. Features are
worked out once per distinct word of a slice, so a text costs one look-up per
word, however long its n-grams are.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from litspark.llm.common import utf8
from litspark.llm.words import BLANK_SEPARATED, Words, mix, split_words

_U = np.uint64


def bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes) % _U(buckets)).astype(np.int64)


def word_features(words: Words, which: np.ndarray, sizes: Iterable[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For the chosen words: (bucket of every feature, where each word's
    features begin). The n-grams run over the word's bytes between two marks."""
    start, end = words.start[which], words.end[which]
    length = end - start
    parts, owner = [bucket(_spans(words, start, end, 0), buckets)], [np.arange(len(which))]
    for n in sizes:
        count = np.maximum(length + 2 - n + 1, 0)  # with a mark in front and behind
        own = np.repeat(np.arange(len(which)), count)
        at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        first = start[own] + np.maximum(at - 1, 0)
        last = np.minimum(start[own] + at - 1 + n, end[own])
        mark = (at == 0).astype(np.int64) + 2 * (at == count[own] - 1)
        parts.append(bucket(_spans(words, first, last, 7 + 4 * n + mark), buckets))
        owner.append(own)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(len(which) + 1))


def _spans(words: Words, start: np.ndarray, end: np.ndarray, salt) -> np.ndarray:
    """Hashes of short spans by their eight-byte blocks; longer ones in full."""
    from litspark.llm.words import span_hashes
    return mix(span_hashes(words.data, start, end) + np.asarray(salt).astype(_U) * _U(0x9E3779B97F4A7C15))


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct word, a place of it, number of every word)."""
    return np.unique(words.hashes(), return_index=True, return_inverse=True)


class Bags:
    """Texts as bags of features in one flat list: ``index`` and ``weight`` of
    text i lie at first[i]:first[i + 1]."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, first: np.ndarray):
        self.index, self.weight, self.first = index, weight, first

    def __len__(self) -> int:
        return len(self.first) - 1

    def rows(self, which: np.ndarray) -> "Bags":
        size = np.diff(self.first)[which]
        at = np.repeat(self.first[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return Bags(self.index[at], self.weight[at], np.concatenate([[0], np.cumsum(size)]))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for every i, empty ones 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def text_words(texts: list[str | None], lower: bool) -> Words:
    data, offsets = utf8(pa.array(texts, pa.string()))
    return split_words(data, offsets, BLANK_SEPARATED, lower=lower)
