import hashlib
import math

import numpy as np
import pytest

from litspark.llm import centroids

KIND = "vec_id bigint, embedding array<float>, label int, x int, cluster string, distance double, h string"


def _clustered(rows, k=8, components=64, rounds=10):
    """The definition, every vector against every centroid in every round."""
    kept = [(i, [math.floor(1024 * float(e)) for e in x]) for i, x in rows
            if x is not None and len(x) == components and all(e is not None and math.isfinite(e) for e in x)]
    sha = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    at = [x for _, x in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for c in range(len(at)):
            mine = [x for (_, x), o in zip(kept, own) if o == c]
            if mine:
                at[c] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *nearest(x)) for i, x in kept]
    total = lambda c: sum(d for _, d, o in found if c in (None, o))
    return sorted(((i, c, d, total(c), total(None), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, d, c in found), key=str)


def _rows(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2, "c", 0.5, "h") for i, x in rows], KIND)


def _vectors(n, seed, components=64, spread=0.2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.3, (12, components))
    return [(i, np.float32(centre[rng.integers(12)] + rng.normal(0, spread, components)).tolist()) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    rows = _vectors(700, 1)
    want = _clustered(rows)
    df = _frame(spark, rows).repartition(5)
    assert _rows(centroids.cluster(df)) == want
    monkeypatch.setattr(centroids, "ROWS", 7)
    assert _rows(centroids.cluster(df)) == want


def test_defined_cases(spark):
    zero = [0.0] * 64
    rows = [(1, None), (2, []), (3, zero[1:]), (4, [*zero[1:], None]), (5, [*zero[1:], float("nan")]), (6, [*zero[1:], float("-inf")]),
            (None, [0.25] * 64), (7, zero), (7, zero), (8, [-0.0004] * 64), (8, [0.5] * 64), (9, zero)]
    rows += [(20 + i, [float(i)] * 32 + [-100.0] * 32) for i in range(5)]
    assert _rows(centroids.cluster(_frame(spark, rows))) == _clustered(rows)
    few = rows[:8]
    assert _rows(centroids.cluster(_frame(spark, few))) == _clustered(few)
    out = centroids.cluster(_frame(spark, rows[:6]))
    assert out.count() == 0
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(_frame(spark, [(1, [1e30] * 64)])).collect()


def test_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-1, 2, 2)] + [0.0] * 62) for i in range(300)]
    assert _rows(centroids.cluster(_frame(spark, rows))) == _clustered(rows)
    same = [(i, [0.1] * 64) for i in range(100)]
    assert _rows(centroids.cluster(_frame(spark, same))) == _clustered(same)


def test_only_expired_gaps_are_rescanned():
    rows = _vectors(2000, 9, spread=0.3)
    x = np.floor(np.array([v for _, v in rows]) * 1024).astype(np.int64)
    now = centroids.Centroids(x[:8].copy(), np.zeros(8))
    block, total = centroids.Block.first(x, now)
    rescanned = []
    for _ in range(30):
        to = np.where(total[:, -1:] > 0, total[:, :-1] // np.maximum(total[:, -1:], 1), now.at)
        if (to == now.at).all():
            break
        now = now.moved(to)
        change, n = block.round(now)
        total += change
        rescanned.append(n)
        assert (block.cluster == ((x[:, None] - now.at) ** 2).sum(2).argmin(1)).all()
        assert (total == centroids.sums(x, block.cluster, 8)).all()
        held = np.concatenate([v for _, v in block.heaps])
        assert sorted(held.tolist()) == list(range(2000))
    assert rescanned[-1] < 1000 and sum(rescanned) < 1500 * len(rescanned), rescanned
