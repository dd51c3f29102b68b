"""The exact similarity ratio of two strings (STR34, UDF1).

2 L / (m + n), L the length of their longest common subsequence: one less the
insertions and deletions that turn one string into the other, over both lengths.
Built-in functions cannot state it, so it is the one Arrow UDF of the text
functions. A batch is computed together: for each pair the positions of the
first string are bits of 64-bit words, and a character of the second advances
all of them with one addition (V' = (V + (V & M)) | (V & ~M), M the positions of
that character); the zero bits left are the subsequence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Cells of the position tables that a step holds.
CELLS = 1 << 22
_ONE = np.uint64(1)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings and where each begins."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat, np.concatenate([[0], np.cumsum(size)])


def _lcs(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences, pair by pair."""
    pairs, words = len(a), -(-max(map(len, a)) // 64)
    flat, begin = _points(a)
    letters, number = np.unique(flat, return_inverse=True)
    size = np.diff(begin)
    pair = np.repeat(np.arange(pairs), size)
    place = np.arange(len(flat)) - begin[pair]
    masks = np.zeros((pairs, len(letters) + 1, words), np.uint64)  # the last letter: one that no first string has
    np.bitwise_or.at(masks, (pair, number, place // 64), _ONE << (place % 64).astype(np.uint64))
    other, start = _points(b)
    known = np.searchsorted(letters, other)
    known[known == len(letters)] = 0
    known = np.where(letters[known] == other, known, len(letters)) if len(letters) else np.zeros(len(other), np.int64)
    width = np.diff(start)
    steps = np.full((pairs, int(width.max(initial=0))), len(letters))
    steps[np.repeat(np.arange(pairs), width), np.arange(len(other)) - np.repeat(start[:-1], width)] = known
    v = np.full((pairs, words), ~np.uint64(0))
    every = np.arange(pairs)
    for column in steps.T:
        m = masks[every, column]
        u = v & m
        carry = np.zeros(pairs, np.uint64)
        for w in range(words):
            total = v[:, w] + u[:, w]
            over = total < u[:, w]
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            v[:, w] = total | (v[:, w] & ~m[:, w])
    held = np.unpackbits((~v).astype("<u8").view(np.uint8).reshape(pairs, -1), axis=1, bitorder="little")
    return (held * (np.arange(words * 64) < size[:, None])).sum(1)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The ratio of every pair, 1 for two empty strings."""
    swap = [len(x) > len(y) for x, y in zip(a, b)]  # the shorter one is kept as bits
    short = [y if s else x for x, y, s in zip(a, b, swap)]
    long = [x if s else y for x, y, s in zip(a, b, swap)]
    total = np.array([len(x) + len(y) for x, y in zip(a, b)])
    out = np.ones(len(a))
    order = sorted((i for i in range(len(a)) if total[i]), key=lambda i: (-(-len(short[i]) // 64), len(long[i])))
    at = 0
    while at < len(order):  # pairs of like lengths together, as many as the tables allow
        end, cells = at, 0
        letters: set[str] = set()
        words = -(-len(short[order[at]]) // 64)
        while end < len(order) and -(-len(short[order[end]]) // 64) == words:
            letters |= set(short[order[end]])
            cells = (end - at + 1) * max((len(letters) + 1) * words, len(long[order[end]]))
            if end > at and cells > CELLS:
                break
            end += 1
        some = order[at:end]
        if words:
            out[some] = 2 * _lcs([short[i] for i in some], [long[i] for i in some]) / total[some]
        else:
            out[some] = 0.0
        at = end
    return out


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a.tolist(), b.tolist()))


def exact_ratio(a, b) -> Column:
    """The exact ratio (0-1) of two lower-cased strings; null if one is null."""
    a, b = (F.lower(F.col(x) if isinstance(x, str) else x) for x in (a, b))
    found = _ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    return F.when(a.isNotNull() & b.isNotNull(), found)
