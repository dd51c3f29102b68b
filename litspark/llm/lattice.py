"""Marginal probabilities of words over all their segmentations into pieces.

The pieces are those of an existing vocabulary; none crosses a blank, so the
lattice of a text falls apart into those of its words. Words of equal length are
worked on together: substrings are looked up by hash, and the forward (and for
expected counts the backward) recursion runs in log space over their positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
START = "▁"
#: Cells (words x positions x piece lengths) that are held at a time.
CELLS = 1_000_000
_TABLE_BITS = 20
#: Stands for log 0 where two may be added.
_NONE = np.float32(-1e30)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U), sizes


def _spread(key: np.ndarray) -> np.ndarray:
    """Keys whose top bits depend on all of a string."""
    return (key ^ (key >> _U(32))) * _U(0xD6E8FEB86659FD93)


class Pieces:
    """A vocabulary: ``names`` of its pieces, the 256 single bytes that stand for
    characters outside it, and the end of a text. Pieces are found by key in an
    open table, next to their home slot if that is taken."""

    def __init__(self, names: list[str]):
        self.names = names
        codes, sizes = _codes(names)
        self.longest = int(sizes.max(initial=1))
        first = np.concatenate([[0], np.cumsum(sizes)])
        key = np.zeros(len(names), _U)
        for k in range(self.longest):
            some = np.flatnonzero(sizes > k)
            key[some] = key[some] * _BASE + codes[first[some] + k] + _U(1)
        self.table, self.number = np.zeros((1 << _TABLE_BITS) + 64, _U), np.zeros((1 << _TABLE_BITS) + 64, np.int32)
        for i, k in enumerate(_spread(key).tolist()):
            at = k >> (64 - _TABLE_BITS)
            while self.table[at]:
                at += 1
            self.table[at], self.number[at] = k, i
        self.bytes_at = len(names)
        self.end = len(names) + 256
        self.size = len(names) + 257

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``key`` of pieces, their numbers)."""
        slot = (key >> _U(64 - _TABLE_BITS)).astype(np.int32)
        there = self.table[slot]
        hit = there == key
        where, number = [np.flatnonzero(hit)], [self.number[slot[hit]]]
        left = np.flatnonzero(~hit & (there != 0))
        step = 1
        while len(left):  # the home slot holds another piece
            at = slot[left] + step
            there = self.table[at]
            same = there == key[left]
            where.append(left[same])
            number.append(self.number[at[same]])
            left = left[~same & (there != 0)]
            step += 1
        return np.concatenate(where), np.concatenate(number)


def vocabulary(path: str) -> tuple[Pieces, np.ndarray]:
    """The word pieces of a model file and the first guess of their
    probabilities: its scores are ranks, read as Zipf's law."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, rank = [], []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        inner = name[1:] if name.startswith(START) else name
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or START in inner or not name:
            continue
        names.append(name)
        rank.append(-model.get_score(i))
    if START not in names:
        names.append(START)
        rank.append(0.0)
    rank = np.minimum(np.array(rank), len(names))
    share = np.concatenate([1 / (rank + 10), np.full(256, 1 / (10 * len(names))), [1 / 100]])
    return Pieces(names), share / share.sum()


def _groups(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words of one length, their codes: position x word)."""
    codes, sizes = _codes([START + t for t in texts])
    first = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(sizes, kind="stable")
    cut = np.flatnonzero(np.diff(sizes[order])) + 1
    for same in np.split(order, cut):
        if not len(same):
            continue
        size = int(sizes[same[0]])
        step = max(1, CELLS // (size * 16))
        for k in range(0, len(same), step):
            some = same[k:k + step]
            yield some, codes[first[some] + np.arange(size)[:, None]]


def _arcs(codes: np.ndarray, pieces: Pieces, logp: np.ndarray) -> tuple[list, list[np.ndarray], dict]:
    """For each piece length m: (places, numbers) of the pieces of that length
    in the flat position x word array, and the scores as an array (log 0 where
    there is none). Characters outside the vocabulary score their bytes; their
    places are listed by character."""
    size, n = codes.shape
    key = np.zeros((size, n), _U)
    found, scores, outside = [], [], {}
    for m in range(1, min(pieces.longest, size) + 1):
        key = key[:size - m + 1] * _BASE + codes[m - 1:]
        key += _U(1)
        place, number = pieces.find(_spread(key.ravel()))
        score = np.full(key.size, _NONE, np.float32)
        score[place] = logp[number]
        if m == 1 and len(place) < key.size:
            rest = np.flatnonzero(score == _NONE)
            chars = codes.ravel()[rest]
            for c in np.unique(chars).tolist():
                byte = np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8).astype(int) + pieces.bytes_at
                outside[c] = (byte, rest[chars == c])
                score[outside[c][1]] = logp[byte].sum()
        found.append((place, number))
        scores.append(score.reshape(key.shape))
    return found, scores, outside


def _logsum(parts: np.ndarray) -> np.ndarray:
    top = parts.max(axis=0)
    parts -= top
    np.exp(parts, out=parts)
    return top + np.log(parts.sum(axis=0))


def _forward(scores: list[np.ndarray], size: int, n: int) -> np.ndarray:
    alpha = np.zeros((size + 1, n), np.float32)
    parts = np.empty((len(scores), n), np.float32)
    for j in range(1, size + 1):
        k = min(len(scores), j)
        for m in range(1, k + 1):
            np.add(alpha[j - m], scores[m - 1][j - m], out=parts[m - 1])
        alpha[j] = _logsum(parts[:k])
    return alpha


def _backward(scores: list[np.ndarray], size: int, n: int) -> np.ndarray:
    beta = np.zeros((size + 1, n), np.float32)
    parts = np.empty((len(scores), n), np.float32)
    for i in range(size - 1, -1, -1):
        k = min(len(scores), size - i)
        for m in range(1, k + 1):
            np.add(beta[i + m], scores[m - 1][i], out=parts[m - 1])
        beta[i] = _logsum(parts[:k])
    return beta


def log_probabilities(texts: list[str], pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """Natural log of the summed probability of all segmentations of each word."""
    out = np.zeros(len(texts))
    logp = logp.astype(np.float32)
    for which, codes in _groups(texts):
        _, scores, _ = _arcs(codes, pieces, logp)
        out[which] = _forward(scores, *codes.shape)[-1]
    return out


def expected_counts(texts: list[str], times: np.ndarray, pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations by their weight."""
    out = np.zeros(pieces.size)
    logp = logp.astype(np.float32)
    for which, codes in _groups(texts):
        size, n = codes.shape
        found, scores, outside = _arcs(codes, pieces, logp)
        alpha, beta = _forward(scores, size, n), _backward(scores, size, n)
        total, weight = alpha[-1], times[which]
        for m, ((place, number), score) in enumerate(zip(found, scores), 1):
            i, w = place // n, place % n
            part = np.exp(alpha[i, w] + score.ravel()[place] + beta[i + m, w] - total[w]) * weight[w]
            out[:len(pieces.names)] += np.bincount(number, weights=part, minlength=len(pieces.names))
            if m == 1:
                for byte, at in outside.values():
                    i, w = at // n, at % n
                    np.add.at(out, byte, (np.exp(alpha[i, w] + score.ravel()[at] + beta[i + 1, w] - total[w]) * weight[w]).sum())
    return out
