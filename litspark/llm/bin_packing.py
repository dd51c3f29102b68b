"""Packing of whole documents into as few windows as possible.

A document is at most a window long or is cut into whole windows and a rest, so
the table of lengths has at most ``WINDOW`` rows however many documents there
are. The plan is made on that table alone:

* Index: the sums of one, two and three available lengths, each a table over
  all sums (the powers of the polynomial of available lengths), kept up to date
  as lengths run out.
* Singles first: lengths that complete each other close as many windows at once
  as the availability counts allow. Then, from the longest length down, a length
  that fits no open window is looked up in the index, and while a single, pair or
  triple fills its gap exactly, windows are closed with it in the same way.
* What no combination completes goes into the smallest gap that holds it (best
  fit), and every new gap is looked up in the index again.

A plan is a list of runs: pieces of one length, so many to a window. Every step
uses up a length or splits a constant number of groups of equal windows, so its
size depends on the window, not on the number of documents, and it is sent to
the tasks.

Pieces are numbered within their length: a task counts its own, the table of
(task, length) counts gives offsets by a running sum over tasks, and the plan
turns a number into a window and a place. A length that a third of all rows
share needs no task to see more than its own rows.

Defined cases: null and empty texts are a single end token; a longer document is
cut into whole windows and a rest; repeated rows are packed one by one; a null
doc_id stays null; an empty table gives no pieces; other columns are not looked
at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark.llm.common import checkpointed, slices, small_batches, table, text_of
from litspark.llm.packing import default_tokenizer, tokenizer_at

WINDOW = 4096
END = 1
#: Least share of a gap that the longest length of a combination takes.
SHARES = (0.0, 0.5, 0.75, 0.9, 0.97, 1.0)


class SumIndex:
    """Which sums one, two and three available lengths reach: the coefficients
    of the first three powers of the polynomial of available lengths."""

    def __init__(self, counts: np.ndarray):
        self.size = len(counts)
        self.counts = counts
        self.one = (counts > 0).astype(np.int64)
        self.one[0] = 0
        self.two = self._times(self.one, self.one)
        self.three = self._times(self.two, self.one)

    def _times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        for i in np.flatnonzero(b).tolist():
            out[i:] += b[i] * a[:self.size - i]
        return out

    def _add(self, to: np.ndarray, what: np.ndarray, shift: int, times: int) -> None:
        if shift < self.size:
            to[shift:] += times * what[:self.size - shift]

    def take(self, length: int, n: int) -> None:
        """``n`` pieces of a length are used; one that runs out leaves the index:
        (p - x^a)^2 = p^2 - 2 x^a p + x^2a, and so on."""
        self.counts[length] -= n
        if n and not self.counts[length]:
            nothing = np.zeros(self.size, np.int64)
            nothing[0] = 1
            self._add(self.three, self.two, length, -3)
            self._add(self.three, self.one, 2 * length, 3)
            self._add(self.three, nothing, 3 * length, -1)
            self._add(self.two, self.one, length, -2)
            self._add(self.two, nothing, 2 * length, 1)
            self.one[length] = 0

    def _pair(self, gap: int, spare: np.ndarray) -> tuple[int, ...]:
        if gap < 2 or not self.two[gap]:
            return ()
        a = np.arange(gap - 1, (gap - 1) // 2, -1)  # the longer one, longest first
        fits = (spare[a] > 0) & (spare[gap - a] > (a == gap - a))
        at = int(fits.argmax())
        return (int(a[at]), gap - int(a[at])) if fits[at] else ()

    def filling(self, gap: int, reserved: int = 0, share: float = 0.0) -> tuple[int, ...]:
        """One, two or three available lengths whose sum is ``gap``, the longest
        at least ``share`` of it, one piece of length ``reserved`` being spoken
        for; empty if there are none."""
        if gap <= 0:
            return ()
        spare = self.counts
        if reserved:
            spare = spare.copy()
            spare[reserved] -= 1
        if spare[gap] > 0:
            return (gap,)
        if (pair := self._pair(gap, spare)) and pair[0] >= share * gap:
            return pair
        if gap < 3 or not self.three[gap]:
            return ()
        a = np.arange(gap - 2, (gap - 1) // 3, -1)
        a = a[a >= share * gap]
        for first in a[(spare[a] > 0) & (self.two[gap - a] > 0)].tolist():
            left = spare.copy()
            left[first] -= 1
            if pair := self._pair(gap - first, left):
                return (first, *pair)
        return ()


def _times_available(counts: np.ndarray, lengths: tuple[int, ...]) -> int:
    return min(int(counts[x]) // lengths.count(x) for x in set(lengths))


Groups = list[tuple[int, list[tuple[int, int]]]]


def plan(counts: dict[int, int], window: int = WINDOW) -> Groups:
    """Groups of equal windows: (how many, [(length, pieces of it in each)]).
    Every piece of ``counts`` (length: pieces) is in exactly one window. Short
    lengths used up early leave long ones alone, so plans are made with several
    ``SHARES`` and the one with the fewest windows is taken."""
    return min((plan_with(share, counts, window) for share in SHARES), key=lambda groups: sum(n for n, _ in groups))


def plan_with(share: float, counts: dict[int, int], window: int = WINDOW) -> Groups:
    """One plan: combinations must hold a length of ``share`` of the gap."""
    left = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        if n:
            left[length] = n
    index = SumIndex(left)
    done: Groups = []
    open_: dict[int, Groups] = {}  # gap: groups of windows with that gap
    gaps: list[int] = []  # those that have any, increasing

    def put(n: int, held: list[tuple[int, int]], gap: int) -> None:
        """``n`` windows with a gap: closed as far as combinations fill it."""
        while n and gap and (fill := index.filling(gap, 0, share)):
            many = min(n, _times_available(left, fill))
            for x in fill:
                index.take(x, many)
            done.append((many, held + [(x, 1) for x in fill]))
            n -= many
        if n and not gap:
            done.append((n, held))
        elif n:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((n, held))

    def close(length: int, share: float) -> None:
        """Windows that a piece of ``length`` and a combination fill exactly."""
        while left[length] and (fill := index.filling(window - length, length, share)):
            lengths = (length, *fill)
            many = _times_available(left, lengths)
            for x in lengths:
                index.take(x, many)
            done.append((many, [(x, 1) for x in lengths]))

    if left[window]:
        done.append((int(left[window]), [(window, 1)]))
        index.take(window, int(left[window]))
    for length in range(window - 1, window // 2 - 1, -1):
        close(length, 1.0)
    for length in range(window - 1, 0, -1):
        while left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # no open window holds it
                close(length, share)
                if not left[length]:
                    break
                n, held, gap = int(left[length]), [], window
            else:  # the smallest gap that holds it
                gap = gaps[at]
                n, held = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            each = min(gap // length, int(left[length]))
            full = min(n, int(left[length]) // each)
            index.take(length, full * each)
            if full < n and held:  # windows that this length does not reach stay open
                put(n - full, held, gap)
            put(full, held + [(length, each)], gap - each * length)
    for groups in open_.values():
        done.extend(groups)
    return done


def places(groups: Groups) -> dict[str, np.ndarray]:
    """The plan as runs sorted by (length, first number): pieces number
    ``number``.. of ``length``, ``each`` to a window from ``window`` on, at ``at``."""
    used: dict[int, int] = {}
    rows, window = [], 0
    for n, held in groups:
        at = 0
        for length, each in held:
            rows.append((length, used.get(length, 0), window, each, at))
            used[length] = used.get(length, 0) + n * each
            at += length * each
        window += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "number", "window", "each", "at"), columns))


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task, seen = tokenizer_at(path), TaskContext.get().partitionId(), np.zeros(WINDOW + 1, np.int64)
        for batch, data, offsets in slices(batches, "text"):
            ids, begin = tokenizer.encode(data, offsets)
            ids[begin[1:] - 1] = END
            size = np.diff(begin)
            many = -(-size // WINDOW)
            doc = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * WINDOW
            length = np.minimum(WINDOW, size[doc] - start)
            first = begin[:-1][doc] + start
            crc = [zlib.crc32(ids[a:a + n]) for a, n in zip(first.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")  # number the pieces of each length in this task
            own, at = np.unique(length[order], return_index=True)
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.repeat(at, np.diff([*at, len(doc)])) + seen[length[order]]
            seen[own] += np.diff([*at, len(doc)])
            ids_of = batch.column(0).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [ids_of, *(pa.array(x, pa.int64()) for x in (piece, start, length)), pa.array(crc, pa.int64()),
                 pa.array(np.full(len(doc), task)), pa.array(nth)], list(_PIECE))
    return run


_PIECE = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "nth")


def _placed(runs: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (runs["length"] << 48) + runs["number"]
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            k = np.searchsorted(key, (length << 48) + number, side="right") - 1
            past, each = number - runs["number"][k], runs["each"][k]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs["window"][k] + past // each),
                                              pa.array(runs["at"][k] + past % each * length)], list(_NAMES))
    return run


_NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    pieces = checkpointed(texts.mapInArrow(_pieces(tokenizer_path), ", ".join(f"{n} bigint" for n in _PIECE)))
    counted = checkpointed(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most WINDOW rows
    runs = places(plan(counts))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    offsets = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["task", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    return (numbered.mapInArrow(_placed(runs), ", ".join(f"{n} bigint" for n in _NAMES))
            .withColumn("piece", F.col("piece").cast("int")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())


SQL = None
