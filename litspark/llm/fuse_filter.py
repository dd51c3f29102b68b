"""Static binary-fuse filters over 64-bit keys, built and probed with numpy.

Every key owns one slot in each of three neighbouring segments; construction
peels, round by round, all slots that hold a single key and fills them in
reverse, so that the three slots of a key xor to its 16-bit fingerprint.  No
stored key is ever reported missing; another key passes with probability 2^-16.
"""

from __future__ import annotations

import struct

import numpy as np

from litspark.llm.words import mix

_U = np.uint64


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys + mix(np.array([seed], _U))[0])
    base = ((h >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64) * segment
    mask = segment - 1
    a = base + (h.astype(np.int64) & mask)
    h2 = mix(h)
    b = base + segment + (h2.astype(np.int64) & mask)
    c = base + 2 * segment + ((h2 >> _U(32)).astype(np.int64) & mask)
    return np.stack([a, b, c]), (mix(h2) & _U(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """Filter for distinct uint64 ``keys`` as bytes (any number, also none)."""
    keys = np.unique(keys.astype(_U))
    n = len(keys)
    segment = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    for seed in range(1, 200):
        segments = max(1, int(np.ceil(n * factor / segment)) - 2) + (seed // 20)
        size = (segments + 2) * segment
        slots, prints = _slots(keys, seed, segment, segments)
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # xor of the key numbers in a slot
        for row in slots:
            np.bitwise_xor.at(held, row, np.arange(n))
        order, left = [], n
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            own, first = np.unique(held[single], return_index=True)
            order.append((own, single[first]))
            left -= len(own)
            for row in slots[:, own]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, own)
        if left == 0:
            break
    else:
        raise RuntimeError("no peeling order found")
    table = np.zeros(size, np.uint16)
    for own, at in reversed(order):
        table[at] = 0
        a, b, c = slots[:, own]
        table[at] = prints[own] ^ table[a] ^ table[b] ^ table[c]
    return struct.pack("<qqqq", n, seed, segment, segments) + table.tobytes()


def probe(filter_: bytes | None, keys: np.ndarray) -> np.ndarray:
    """Per key: False only if it is certainly not in the filter."""
    if not filter_:
        return np.zeros(len(keys), bool)
    n, seed, segment, segments = struct.unpack_from("<qqqq", filter_)
    if n == 0:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(filter_, np.uint16, offset=32)
    (a, b, c), prints = _slots(keys.astype(_U), seed, segment, segments)
    return (table[a] ^ table[b] ^ table[c]) == prints
