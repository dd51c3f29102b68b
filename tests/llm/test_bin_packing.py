import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litspark.llm import bin_packing
from litspark.llm.packing import default_tokenizer
from tests.llm.conftest import texts


def _best_fit_decreasing(lengths, window):
    gaps, windows = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else window
        windows += gap == window
        if gap > x:
            insort(gaps, gap - x)
    return windows


def _held(groups, window):
    total = Counter()
    for n, held in groups:
        assert n > 0 and sum(x * k for x, k in held) <= window
        for x, k in held:
            total[x] += n * k
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_every_piece_is_in_one_window(lengths):
    counts = Counter(lengths)
    groups = bin_packing.plan(dict(counts), 64)
    assert _held(groups, 64) == counts
    assert sum(n for n, _ in groups) <= _best_fit_decreasing(lengths, 64) + 1 + len(lengths) // 100
    runs = bin_packing.places(groups)
    seen = defaultdict(dict)  # window: place -> length, from the numbers of the pieces
    key = (runs["length"] << 48) + runs["number"]
    for x, n in counts.items():
        for number in range(n):
            k = int(np.searchsorted(key, (x << 48) + number, side="right")) - 1
            past = number - int(runs["number"][k])
            assert runs["length"][k] == x
            place = seen[int(runs["window"][k]) + past // int(runs["each"][k])]
            at = int(runs["at"][k]) + past % int(runs["each"][k]) * x
            assert at not in place
            place[at] = x
    assert len(seen) == sum(n for n, _ in groups)
    for place in seen.values():
        end = 0
        for at in sorted(place):
            assert at == end
            end += place[at]
        assert end <= 64


@pytest.mark.parametrize("gap", range(1, 41))
def test_the_index_finds_a_combination_where_one_exists(gap):
    rng = np.random.default_rng(gap)
    counts = np.zeros(41, np.int64)
    counts[rng.integers(1, 41, 6)] = rng.integers(1, 3, 6)
    index = bin_packing.SumIndex(counts)
    while True:
        have = [int(x) for x in np.flatnonzero(counts) for _ in range(counts[x])]
        sums = set(have) | {a + b for i, a in enumerate(have) for b in have[i + 1:]}
        sums |= {a + b + c for i, a in enumerate(have) for j, b in enumerate(have[i + 1:], i + 1) for c in have[j + 1:]}
        fill = index.filling(gap)
        assert bool(fill) == (gap in sums)
        if not fill:
            break
        assert sum(fill) == gap and not Counter(fill) - Counter(have)
        for x in fill:
            index.take(x, 1)


def test_equal_lengths_and_sums_that_complete_each_other():
    assert sum(n for n, _ in bin_packing.plan({2048: 1001, 1: 4096})) == 502
    assert bin_packing.plan({}) == []
    assert sum(n for n, _ in bin_packing.plan({4096: 3, 3000: 10, 1000: 10, 96: 10})) == 13
    assert len(bin_packing.plan({700: 10 ** 9})) <= 2  # the plan does not grow with the count


def test_packed_documents(edge, none):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = bin_packing.pack(edge, default_tokenizer()).collect()
    ids = [(i, tokenizer.encode(t, add_special_tokens=False).ids + [bin_packing.END]) for i, t in texts()]
    want = Counter()
    for i, x in ids:
        for piece, at in enumerate(range(0, len(x), 4096)):
            part = np.array(x[at:at + 4096], "<u4")
            want[(i, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for place in places.values():
        place.sort()
        assert [a for a, _ in place] == [sum(n for _, n in place[:k]) for k in range(len(place))]
        assert sum(n for _, n in place) <= 4096
    lengths = [r.length for r in rows]
    assert len(places) <= _best_fit_decreasing(lengths, 4096)
    assert bin_packing.pack(none, default_tokenizer()).count() == 0


def test_windows_with_many_partitions_and_a_hot_length(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same words again")).otherwise(
        F.repeat(F.lit("many words "), (F.col("id") % 700).cast("int"))).alias("text")).repartition(7, "doc_id")
    rows = bin_packing.pack(docs, default_tokenizer()).toPandas()
    assert len(rows) == 3000 and rows["doc_id"].nunique() == 3000
    assert not rows.duplicated(["sequence_id", "offset"]).any()
    filled = rows.groupby("sequence_id").agg(n=("length", "sum"), last=("offset", "max"))
    assert filled["n"].max() <= 4096
    assert len(filled) <= -(-rows["length"].sum() // 4096) + 2
