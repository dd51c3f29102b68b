import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from litspark.llm import components, exact_dedup, fuse_filter, near_dedup
from litspark.llm.words import BLANK_SEPARATED, shingle_sets, split_words
from litspark.llm.common import utf8
from tests.llm.conftest import EDGE, texts

import pyarrow as pa


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t)


def test_fuse_filter_has_no_false_negative():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 5, 17, 1000, 30000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        held = fuse_filter.build(keys)
        assert fuse_filter.probe(held, keys).all()
        assert fuse_filter.probe(held, rng.integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.001
    assert not fuse_filter.probe(None, np.arange(3).astype(np.uint64)).any()


def test_exact_dedup_edges(edge):
    got = exact_dedup.exact_dedup(*exact_dedup.split_by_id(edge)).collect()
    assert len(got) == len(EDGE)
    groups = defaultdict(list)
    for i, t in texts():
        groups[_norm(t)].append((-len(t), i is None, i or 0, i))
    want = defaultdict(list)
    for i, t in texts():
        g = sorted(groups[_norm(t)])
        want[i].append((g[0][3], len(g), hashlib.sha256(_norm(t).encode()).hexdigest()))
    for r in got:
        assert (r.keep_id, r.group_size, r.text_sha256) in want[r.doc_id]
        assert r.kept == (r.doc_id == r.keep_id)
    # longest original first, then the smallest id
    assert {r.doc_id: r.keep_id for r in got}[4] == 5
    assert {r.doc_id: r.keep_id for r in got}[1] == 3


def test_exact_dedup_snapshot_and_batch_in_any_split(spark):
    rows = [(i, random.Random(i % 7).choice(["a b", "ab", "c", "", None, "d e f"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    results = []
    for cut in (0, 20, 60):
        out = exact_dedup.exact_dedup(docs.filter(f"doc_id < {cut}"), docs.filter(f"doc_id >= {cut}"))
        results.append(sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()))
    assert results[0] == results[1] == results[2]


def test_exact_dedup_batch_far_larger_than_the_snapshot(spark, monkeypatch):
    """The shards follow the larger side, on both ways to the candidates' texts."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2500).cast("string")).alias("text"))
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 100)
    snapshot, batch = docs.filter("doc_id < 3"), docs.filter("doc_id >= 3")
    assert exact_dedup.shards_for(exact_dedup.grouped(exact_dedup.digests(snapshot)), exact_dedup.grouped(exact_dedup.digests(batch))) == 25
    for bound in (exact_dedup.BROADCAST_PAIRS, 0):
        monkeypatch.setattr(exact_dedup, "BROADCAST_PAIRS", bound)
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(snapshot, batch).collect()}
        assert got == {i: (i % 2500, 3 if i % 2500 < 1000 else 2) for i in range(6000)}


def test_drop_copies_keeps_one_row_and_all_columns(edge, none):
    out = exact_dedup.drop_copies(edge)
    assert out.columns == edge.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len(kept) == len({_norm(t) for _, t in texts()})
    assert sorted(_norm(t or "") for _, t in kept) == sorted({_norm(t) for _, t in texts()})
    assert exact_dedup.drop_copies(none).count() == 0


def test_shingles_by_hash_match_shingles_by_text():
    data, offsets = utf8(pa.array([t for _, t in EDGE]))
    for (_, t), s in zip(texts(), shingle_sets(split_words(data, offsets, BLANK_SEPARATED))):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert len(s) == (len({tuple(x.lower() for x in w[k:k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)))


def _brute(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if sets[a][1] and sets[b][1] and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = i if least[find(k)] is None else min(least[find(k)], i)
    return sorted(((i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets)), key=str)


def _got(docs):
    rows = near_dedup.near_duplicates(docs).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def test_near_dedup_edges(edge, none):
    assert _got(edge) == _brute(texts())
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.drop_near_copies(edge).columns == edge.columns


def test_near_dedup_families_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    shared = [rng.choice(words) for _ in range(60)]
    rows = []
    for family in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([4, 12, 60, 200, 400]))] + (shared if family % 2 else [])
        for copy in range(14):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    assert _got(spark.createDataFrame(rows, "doc_id bigint, text string")) == _brute(rows)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r.node: r.root for r in got} == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 140)}}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_sets_that_share_a_number_are_told_apart(spark, monkeypatch):
    """With numbers of a few bits many sets collide; the result is the same."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 40))]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words, "more"])), (3 * i + 2, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    result = lambda: sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    want = result()
    node = near_dedup._node
    monkeypatch.setattr(near_dedup, "_node", lambda seed: node(seed) if seed > 1 else F.pmod(node(seed), F.lit(20)))
    assert not near_dedup.shared_nodes(near_dedup.sketches(docs)).isEmpty()
    assert result() == want


def test_likely_rows_hold_every_id_and_few_others(spark):
    """The texts that are not candidates stay where they are."""
    from litspark.llm.near_dedup import likely
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).unionByName(spark.sql("select cast(null as bigint) doc_id, 't' text"))
    ids = spark.range(0, 20000, 40).toDF("first_id").unionByName(spark.sql("select cast(null as bigint) first_id"))
    out = likely(rows, "doc_id", ids, 501)
    got = {r.doc_id for r in out.collect()}
    assert {r.first_id for r in ids.collect()} <= got and len(got) < 501 + 20000 / 8
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert likely(rows, "doc_id", ids.limit(0), 0).count() == 0
