"""Edit distances of one string to many, as bits of 64-bit words (JN10).

The column of the distance table is kept as its vertical differences, a bit per
character of the string: one character of the other string moves all of it with
a handful of word operations (Myers; blocks with carries for longer strings).
All other strings of a chunk advance together, one character a step.
"""

from __future__ import annotations

import numpy as np

#: Cells of a padded chunk of strings.
CELLS = 1 << 21
_ONE, _ALL, _TOP = np.uint64(1), ~np.uint64(0), np.uint64(63)


class Texts:
    """Strings by length, in chunks of padded code points."""

    def __init__(self, texts: list[str]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.order = np.argsort(size, kind="stable")
        self.size = size[self.order]
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.letters, number = np.unique(flat, return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)])
        self.chunks = []  # first string, letters by (position, string)
        at = 0
        while at < len(texts):
            end = at + 1
            while end < len(texts) and (end + 1 - at) * self.size[end] <= CELLS:
                end += 1
            width = int(self.size[end - 1])
            cells = np.zeros((width, end - at), np.int64)
            for column, i in enumerate(self.order[at:end].tolist()):
                cells[:size[i], column] = number[begin[i]:begin[i + 1]]
            self.chunks.append((at, cells))
            at = end

    def distances(self, text: str, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Edit distances to the strings of ``least`` to ``most`` characters: which
        strings, and the distances."""
        lo, hi = np.searchsorted(self.size, [least, most + 1]).tolist()
        out = np.zeros(max(hi - lo, 0), np.int64)
        if hi <= lo:
            return self.order[:0], out
        words = -(-len(text) // 64)
        table = np.zeros((words, len(self.letters) + 1), np.uint64)
        where = dict(zip(self.letters.tolist(), range(len(self.letters))))
        for i, c in enumerate(text):
            table[i // 64, where.get(ord(c), len(self.letters))] |= _ONE << np.uint64(i % 64)
        for first, cells in self.chunks:
            a, b = max(lo, first), min(hi, first + cells.shape[1])
            if a < b:
                out[a - lo:b - lo] = _advance(table, len(text), cells[:, a - first:b - first], self.size[a:b])
        return self.order[lo:hi], out


def _advance(table: np.ndarray, m: int, cells: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Distances of the string in ``table`` to strings sorted by length."""
    if not m:
        return size.copy()
    words, n = len(table), len(size)
    plus, minus = np.full((words, n), _ALL), np.zeros((words, n), np.uint64)
    score = np.full(n, m, np.int64)
    last = np.uint64((m - 1) % 64)
    ended = np.searchsorted(size, np.arange(int(size[-1])), side="right").tolist()  # strings without a character there
    for j, done in enumerate(ended):
        letters = cells[j, done:]
        up, down = _ONE, np.uint64(0)  # the first row grows by one a step
        for w in range(words):
            pv, mv = plus[w, done:], minus[w, done:]
            eq = table[w][letters]
            xv = eq | mv
            eq |= down
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            top = last if w == words - 1 else _TOP
            grows, falls = (ph >> top) & _ONE, (mh >> top) & _ONE
            ph, mh = (ph << _ONE) | up, (mh << _ONE) | down
            plus[w, done:] = mh | ~(xv | ph)
            minus[w, done:] = ph & xv
            up, down = grows, falls
        score[done:] += up.astype(np.int64) - down.astype(np.int64)
    return score
