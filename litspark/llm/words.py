"""Words of whole UTF-8 texts as numpy arrays: positions and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes inside words: anything but space and \t..\r ...
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[32, 9, 10, 11, 12, 13]] = False
#: ... or ASCII letters and digits and every byte of a non-ASCII character.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    data: np.ndarray      # bytes, lower-cased on demand, with 8 zero bytes behind
    start: np.ndarray     # byte position of each word
    end: np.ndarray
    first: np.ndarray     # first word of each text; one entry more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every pair; data must have 8 spare
    bytes behind. Spans are read eight bytes at a time, all spans at once."""
    size = (end - start).astype(np.int64)
    h = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(0x1234567))
    if len(size) == 0:
        return h
    window = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    keep = (_U(0xFFFFFFFFFFFFFFFF) >> (_U(8) * np.arange(8, 0, -1).astype(_U) - _U(8)))  # by bytes kept - 1
    active, done = None, 0
    while True:
        left = (size if active is None else size[active]) - done
        at = (start if active is None else start[active]) + done
        part = window[at] & keep[np.minimum(left, 8) - 1]
        if active is None:
            h = mix(h ^ part)
            more = size > 8
            active = np.flatnonzero(more)
        else:
            h[active] = mix(h[active] ^ part)
            active = active[left > 8]
        if not len(active):
            return h
        done += 8


def split_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    data = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    n = int(offsets[-1])
    here = inside[data[:n]]
    before = np.zeros(n, bool)
    before[1:] = here[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = here[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(here & ~before)
    end = np.flatnonzero(here & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], _U)


def shingle_sets(words: Words, width: int = 5) -> list[np.ndarray]:
    """For each text its distinct ``width``-word shingles as sorted 64-bit
    hashes; fewer words make one shingle of them all, none make none."""
    h = words.hashes()
    n = len(h) - width + 1
    grams = None
    if n > 0:
        grams = h[:n] * _STEP[0]
        for k in range(1, width):
            grams = mix(grams) + h[k:n + k] * _STEP[k % len(_STEP)]
        grams = mix(grams)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a:b - width + 1]))
        elif b > a:
            whole = np.array([b - a], _U)
            for k in range(a, b):
                whole = mix(whole) + h[k:k + 1] * _STEP[1]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, _U))
    return out
