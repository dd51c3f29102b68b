"""Operators against brute-force results on small frames, and their properties."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from litspark.operators import aggregates as ag
from litspark.operators import evaluation as ev
from litspark.operators import joins as jn
from litspark.operators import sampling as sm
from litspark.operators import terms
from litspark.operators import vectors as vx
from litspark.operators import windows as wn


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 700), np.round(rng.normal(size=700), 2))]
    rows.append((9, 1.5))  # single-row group
    df = spark.createDataFrame(rows, "g int, v double")
    rows += [(None, float(v)) for v in range(7)] + [(1, None), (1, float("nan")), (4, None)]  # null group, null values
    df = spark.createDataFrame(rows, "g int, v double")
    out = ag.exact_percentiles(df, "v", ["g"], [0.25, 0.5, 0.75]).collect()
    assert {r["g"] for r in out} == {0, 1, 2, 9, None} and len(out) == 15
    for r in out:
        vals = [v for g, v in rows if g == r["g"] and v is not None and v == v]
        assert abs(r["value"] - np.quantile(vals, r["p"])) < 1e-9


def test_top_k_and_nearest_k(spark):
    rows = [(i % 3, i, float((i * 37) % 101)) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, id long, s double")
    got = {(r["g"], r["id"]) for r in wn.top_k(df, ["g"], F.col("s"), 5, [F.col("id").asc()]).collect()}
    exp = set()
    for g in range(3):
        sel = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1]))[:5]
        exp |= {(g, r[1]) for r in sel}
    assert got == exp
    near = wn.nearest_k(df, F.col("s"), F.lit(50.0), ["g"], 4, "id").collect()
    for g in range(3):
        sel = sorted([r for r in rows if r[0] == g], key=lambda r: (abs(r[2] - 50.0), r[1]))[:4]
        assert {r["id"] for r in near if r["g"] == g} == {r[1] for r in sel}


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(0, 500).withColumn("k", (F.col("id") * 7919) % 503).repartition(7)
    r = wn.global_rank(df, [F.col("k"), F.col("id")]).collect()
    pos = sorted((x["rank"], x["k"], x["id"]) for x in r)
    assert [p[0] for p in pos] == list(range(1, 501))
    assert [(p[1], p[2]) for p in pos] == sorted((p[1], p[2]) for p in pos)


def test_first_n_by_hash_equals_sorted_hash(spark):
    import hashlib
    df = spark.range(0, 200).withColumnRenamed("id", "k")
    got = {r["k"] for r in sm.first_n_by_hash(df, 17, "k", 43).collect()}
    exp = set(sorted(range(200), key=lambda k: (hashlib.md5(f"43:{k}".encode()).hexdigest(), k))[:17])
    assert got == exp


def test_stratified_quota_never_exceeded(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(200)], "k long, s string")
    out = sm.stratified_equal(df, "s", 50, "k", 1, 2).groupBy("s").count().collect()
    assert all(r["count"] <= 20 for r in out) and sum(r["count"] for r in out) == 40


def test_oversample_ratio_and_undersample(spark):
    df = spark.createDataFrame([(i, 0 if i < 30 else 1) for i in range(100)], "k long, y int")
    over = {r["y"]: r["count"] for r in sm.oversample(df, "y", 0, 1.0, "k", 3).groupBy("y").count().collect()}
    assert over == {0: 70, 1: 70}
    under = {r["y"]: r["count"] for r in sm.undersample(df, "y", 1, 1.0, "k", 3).groupBy("y").count().collect()}
    assert under == {0: 30, 1: 30}


def test_folds_partition_rows(spark):
    df = spark.createDataFrame([(i, i % 4 == 0) for i in range(103)], "k long, y boolean")
    f = sm.kfold(df, 5, "k", 9, stratify="y").collect()
    assert len(f) == 103 and len({r["k"] for r in f}) == 103
    sizes = {}
    for r in f:
        sizes[(r["y"], r["fold"])] = sizes.get((r["y"], r["fold"]), 0) + 1
    for y in (True, False):
        s = [v for (yy, _), v in sizes.items() if yy == y]
        assert max(s) - min(s) <= 1


def test_split_size(spark):
    df = spark.range(0, 101).withColumnRenamed("id", "k")
    out = sm.split_train_validation(df, 0.2, "k", 42)
    assert out.where("split = 'validation'").count() == math.ceil(0.2 * 101)


def greedy(tokens, accepted):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in accepted:
            out.append(tokens[i] + "_" + tokens[i + 1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_phrase_merge_equals_greedy_scan(spark):
    rng = np.random.default_rng(5)
    vocab = ["a", "b", "c", "d"]
    sents = [(i, [str(x) for x in rng.choice(vocab, rng.integers(0, 9))]) for i in range(300)]
    accepted = {("a", "b"), ("b", "a"), ("c", "c"), ("d", "a")}
    df = spark.createDataFrame(sents, "sid long, toks array<string>")
    ph = spark.createDataFrame([(f"{x}_{y}",) for x, y in accepted], "phrase string")
    got = {r["sid"]: r["phrased"] for r in terms.apply_phrases(df, ph, ["sid"]).collect()}
    for sid, toks in sents:
        assert got[sid] == greedy(toks, accepted)


def test_phrase_scores(spark):
    sents = [(i, ["new", "york", "is", "big"]) for i in range(10)] + [(100, ["new", "car"])]
    df = spark.createDataFrame(sents, "sid long, toks array<string>")
    ph = {r["phrase"]: r["score"] for r in terms.learn_phrases(df, min_count=5, threshold=0.0).collect()}
    n_vocab = 5 + 4  # distinct words + distinct pairs
    assert abs(ph["new_york"] - (10 - 5) * n_vocab / (11 * 10)) < 1e-12


def test_tfidf_weights_l2(spark):
    toks = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c")], "doc_id long, term string")
    tf = terms.term_frequencies(toks)
    vocab = terms.fit_vocabulary(tf, max_df=1.0)
    w = terms.tfidf_weights(tf, vocab).collect()
    for d in (1, 2, 3):
        assert abs(sum(r["weight"] ** 2 for r in w if r["doc_id"] == d) - 1.0) < 1e-12
    idf = {r["term"]: r["idf"] for r in vocab.collect()}
    assert abs(idf["a"] - (math.log(4 / 2) + 1)) < 1e-12


def test_mean_vectors_and_knn(spark):
    rows = [(1, [1.0, 0.0], 2), (1, [3.0, 2.0], 1), (2, [0.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "g long, embedding array<float>, w long")
    got = {r["g"]: r["mean_vector"] for r in vx.mean_vectors(df, ["g"], 2, weight_col="w").collect()}
    assert np.allclose(got[1], [(2 * 1 + 3) / 3, 2 / 3]) and np.allclose(got[2], [0, 4])
    train = spark.createDataFrame([(i, [float(i), 0.0], int(i >= 5)) for i in range(10)], "tid long, tv array<float>, tl int")
    q = spark.createDataFrame([(100, [1.2, 0.0]), (101, [8.9, 0.0])], "qid long, v array<float>")
    out = {r["qid"]: r["knn_label"] for r in vx.knn_vote(q, "qid", "v", train, "tid", "tv", "tl", k=3).collect()}
    assert out == {100: 0, 101: 1}


def test_one_to_one_join_fails_on_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    b = spark.createDataFrame([(1,)], "k int")
    try:
        jn.join_one_to_one(a, b, ["k"])
        raise AssertionError("expected a key violation")
    except jn.KeyViolation:
        pass
    assert jn.join_one_to_one(b, b, ["k"]).count() == 1


def test_confusion_and_auc(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1)]
    df = spark.createDataFrame(rows, "y int, p int, s double")
    cm = {(r["y"], r["p"]): r["n"] for r in ev.confusion(df, "y", "p").collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    pos = [s for y, _, s in rows if y == 1]
    neg = [s for y, _, s in rows if y == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(ev.roc_auc(df, "y", "s").first()["auc"] - exp) < 1e-12


def test_edge_groups_do_not_fail(spark):
    """Constant columns, one- and two-row groups, zero vectors: NULL, never an error."""
    rows = [(1, 5.0), (1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0), (3, 7.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    sk = {r["g"]: r["sk"] for r in df.groupBy("g").agg(ag.skewness_corrected("v").alias("sk")).collect()}
    assert sk[2] is None and sk[3] is None
    h = ag.histogram(df, "v", 5, ["g"]).collect()
    assert sum(r["count"] for r in h) == len(rows)
    v = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert v.select(vx.cosine_distance(F.col("a"), F.col("b"))).first()[0] is None


def test_reference_pieces_give_the_same_answers(spark, monkeypatch):
    """Large reference sets are split into pieces; results equal the one-piece run."""
    train = spark.createDataFrame([(i, [float(i % 13), float(i % 7)], i % 3) for i in range(60)],
                                  "tid long, tv array<float>, tl int")
    q = spark.createDataFrame([(100 + j, [float(j), float(j % 5)]) for j in range(12)], "qid long, v array<float>")
    one = {r["qid"]: (r["knn_label"], r["knn_votes"]) for r in vx.knn_vote(q, "qid", "v", train, "tid", "tv", "tl").collect()}
    d_one = sorted((r["qid"], r["tid"], round(r["distance"], 9)) for r in
                   vx.distances_to_references(q, "v", train, "tid", "tv", "euclidean").collect())
    monkeypatch.setattr(vx, "BLOCK_ROWS", 10)
    many = {r["qid"]: (r["knn_label"], r["knn_votes"]) for r in vx.knn_vote(q, "qid", "v", train, "tid", "tv", "tl").collect()}
    d_many = sorted((r["qid"], r["tid"], round(r["distance"], 9)) for r in
                    vx.distances_to_references(q, "v", train, "tid", "tv", "euclidean").collect())
    assert one == many and d_one == d_many


def test_first_n_with_ties(spark):
    """n largest by score, ties by term."""
    rows = [(f"t{i:03d}", (i * 7) % 11) for i in range(120)]
    df = spark.createDataFrame(rows, "term string, cf long")
    got = [(r["term"], r["rank"]) for r in wn.first_n(df, 25, F.col("cf"), F.col("term")).orderBy("rank").collect()]
    exp = sorted(rows, key=lambda r: (-r[1], r[0]))[:25]
    assert [t for t, _ in got] == [t for t, _ in exp] and [k for _, k in got] == list(range(1, 26))


def test_null_rules_of_ranks_and_samples(spark):
    rows = [(1, 10, 5.0), (1, 11, None), (1, 12, 7.0), (None, 13, 1.0), (None, 14, None), (2, 15, None)]
    df = spark.createDataFrame(rows, "g int, id long, s double")
    got = {(r["g"], r["id"], r["rank"]) for r in wn.top_k(df, ["g"], F.col("s"), 2, [F.col("id").asc()]).collect()}
    assert got == {(1, 12, 1), (1, 10, 2), (None, 13, 1), (None, 14, 2), (2, 15, 1)}
    keys = spark.createDataFrame([(None, 7)] * 3 + [("a", 7)] * 3 + [("a", 8), ("b", None)], "g string, k long")
    for n in (1, 2, 100):
        got = sm.first_n_by_hash(keys, n, "k", 5, ["g"]).groupBy("g").count().collect()
        assert {r["g"]: r["count"] for r in got} == {None: min(n, 3), "a": min(n, 4), "b": 1}
    assert sm.first_n_by_hash(keys, 0, "k", 5, ["g"]).count() == 0
    labels = spark.createDataFrame([(i, [0, 1, 1, 1, None][i % 5]) for i in range(50)], "k long, y int")
    got = {r["y"]: r["count"] for r in sm.undersample(labels, "y", 1, 1.0, "k", 3).groupBy("y").count().collect()}
    assert got == {0: 10, 1: 10, None: 10}


def test_repeated_reference_keys_end(spark, monkeypatch):
    monkeypatch.setattr(vx, "BLOCK_ROWS", 2)
    train = spark.createDataFrame([(1, [0.0], 0)] * 5, "tid long, tv array<float>, tl int")
    q = spark.createDataFrame([(1, [0.5])], "qid long, v array<float>")
    assert vx.knn_vote(q, "qid", "v", train, "tid", "tv", "tl").first()["knn_label"] == 0
    assert vx.distances_to_references(q, "v", train, "tid", "tv", "euclidean").count() == 5


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_closest_title_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{'xyz'[k % 3] * (k % 5)}{k}" for k in range(25)]
    names = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 8)))) for k in range(60)]
    names += [(100, "odd1 a"), (101, "odd2 b"), (102, "odd3 c"), (103, "market labor power state culture"),
              (104, "market labor"), (105, "power state"), (106, "culture"), (107, "market labor power state culture"), (108, None), (None, "unknown")]
    asked = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 8)))) for k in range(40)]
    asked += [(50, "odd1 odd2 odd3 market labor power state culture"), (51, "unknown"), (52, ""), (53, None), (54, "unknown")]
    for k in range(60, 90):  # a few edits away from a name
        chars = list(names[k % 50][1])
        for _ in range(rng.randint(0, 6)):
            chars[rng.randrange(len(chars))] = rng.choice(["", "x", "é", "zz"])
        asked.append((k, "".join(chars)))
    fold = lambda x: x.replace("é", "e")
    want = {}
    for q, a in asked:
        scored = [(math.floor(100 * (1 - _edits(fold(a), b) / max(len(fold(a)), len(b))) + 0.5), -n)
                  for n, b in names if a is not None and n is not None and b is not None]
        want[q] = (-max(scored)[1], max(scored)[0]) if scored else (None, None)
    assert want[50][0] == 103 and want[53] == (None, None)
    ask = lambda: jn.closest_title(spark.createDataFrame(asked, "q int, a string"), "q", "a",
                                   spark.createDataFrame(names, "n int, b string"), "n", "b").collect()
    assert {r.q: (r.n, r.similarity) for r in ask()} == want
    for name, value in (("SEEDS", 3), ("SENT_TITLES", 7)):
        monkeypatch.setattr(jn, name, value)
    assert {r.q: (r.n, r.similarity) for r in ask()} == want
    nothing = jn.closest_title(spark.createDataFrame(asked, "q int, a string"), "q", "a", spark.createDataFrame([], "n int, b string"), "n", "b")
    assert {(r.n, r.similarity) for r in nothing.collect()} == {(None, None)} and nothing.count() == len(asked)


def test_the_segment_index_proves_near_titles_alone(spark, monkeypatch):
    """Titles within a few edits of a name never meet the other names."""
    names = [(k, f"a study of {w} in the field of {w[::-1]} number {k}") for k, w in enumerate(["culture", "markets", "networks", "power"] * 50)]
    asked = [(k, names[k][1].replace("study", "stady")) for k in range(0, 200, 7)]
    met = []
    reaching = jn._reaching
    monkeypatch.setattr(jn, "_reaching", lambda titles, known: met.append(titles.count()) or reaching(titles, known))
    out = jn.closest_title(spark.createDataFrame(asked, "q int, a string"), "q", "a", spark.createDataFrame(names, "n int, b string"), "n", "b")
    assert {r.q: r.n for r in out.collect()} == {k: k for k, _ in asked}
    assert met == [0, 0]


def _scanned(toks, accepted, connectors):
    """The sentence read from left to right, one word at a time."""
    out, start, between = [], None, []
    for w in toks:
        if w in connectors:
            (out if start is None else between).append(w)
        elif start is None:
            start = w
        elif "_".join([start, *between, w]) in accepted:
            out.append("_".join([start, *between, w]))
            start, between = None, []
        else:
            out += [start, *between]
            start, between = w, []
    return out + ([] if start is None else [start, *between])


def test_phrases_across_connectors_equal_the_scan(spark, monkeypatch):
    rng = random.Random(11)
    sents = [[rng.choice(["a", "b", "c", "of", "the"]) for _ in range(rng.randrange(0, 12))] for _ in range(300)]
    accepted = ["a_of_b", "a_b", "b_the_of_c", "c_c", "b_c", "of_a", "a_of_the_a"]
    df = spark.createDataFrame([(k % 7 if k else None, k, x) for k, x in enumerate(sents)], "d int, k int, toks array<string>").repartition(3)
    phrases = spark.createDataFrame([(p,) for p in accepted + accepted[:2]], "phrase string")
    for bound in (terms.BROADCAST_PHRASES, 0):
        monkeypatch.setattr(terms, "BROADCAST_PHRASES", bound)
        for conn in (["of", "the"], None):
            got = {r.k: r.phrased for r in terms.apply_phrases(df, phrases, ["d", "k"], connectors=conn).collect()}
            assert got == {k: _scanned(x, accepted, conn or []) for k, x in enumerate(sents)}


def _nearest(rows, refs, k, exclude_self):
    out = {}
    for q, x in rows:
        d = sorted((math.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(x, y))), r) for r, y in refs if not (exclude_self and r == q))
        out[q] = d[:k]
    return out


def test_nearest_references_compare_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 40, (25, 8))
    refs = [(i, np.float32(centre[i % 25] + rng.normal(0, 1, 8)).tolist()) for i in range(2500)]
    refs += [(3000 + i, [1.0] * 8) for i in range(300)]  # copies
    rows = [(10000 + i, np.float32(centre[i % 25] + rng.normal(0, 1, 8)).tolist()) for i in range(200)] + [(99, [1.0] * 8)]
    monkeypatch.setattr(vx, "BLOCK_ROWS", 20)
    compared = []
    of_blocks = vx._best_of_blocks

    def counted(met, blocks, *args):
        compared.append(met.join(blocks.select("_b", "_n"), "_b").agg(F.sum("_n")).first()[0] or 0)
        return of_blocks(met, blocks, *args)

    monkeypatch.setattr(vx, "_best_of_blocks", counted)
    frame = lambda x: spark.createDataFrame(x, "id long, v array<float>").repartition(3)
    for bound in (vx.BROADCAST_BYTES, 0):
        monkeypatch.setattr(vx, "BROADCAST_BYTES", bound)
        compared.clear()
        out = vx.nearest_references(frame(rows), "id", "v", frame(refs).withColumnsRenamed({"id": "r", "v": "w"}), "r", "w", [], 5)
        got = {r["id"]: [(s["d"], s["id"]) for s in r["nearest"]] for r in out.collect()}
        want = _nearest(rows, refs, 5, False)
        assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
        assert sum(compared) < 0.25 * len(rows) * len(refs)
    own = vx.nearest_references(frame(refs[:300]), "id", "v", frame(refs[:300]).withColumnsRenamed({"id": "r", "v": "w"}), "r", "w", [], 4, True)
    assert {r["id"]: [s["id"] for s in r["nearest"]] for r in own.collect()} == {
        q: [i for _, i in x] for q, x in _nearest(refs[:300], refs[:300], 4, True).items()}


def test_nearest_references_of_small_and_missing_tables(spark):
    frame = lambda x, *n: spark.createDataFrame(x, "id long, v array<float>").toDF(*n)
    rows = [(1, [0.0, 1.0]), (2, None), (None, [5.0, 5.0])]
    refs = [(1, [0.0, 0.0]), (7, [0.0, 2.0]), (8, None)]
    out = vx.nearest_references(frame(rows, "id", "v"), "id", "v", frame(refs, "r", "w"), "r", "w", [], 5)
    assert {r["id"]: [s["id"] for s in r["nearest"]] for r in out.collect()} == {1: [1, 7], None: [7, 1]}
    assert vx.nearest_references(frame(rows, "id", "v"), "id", "v", frame(refs, "r", "w").limit(0), "r", "w", [], 5).count() == 0


def test_distinct_sketches_merge(spark):
    df = spark.range(60000).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") * 7919 % 20011).alias("v"))
    df = df.unionByName(spark.createDataFrame([(1, 1, None), (None, 0, 5)], "a long, b long, v long"))
    stored = ag.distinct_sketches(df, ["a", "b"], "v")
    for group in (["a"], ["b"]):
        exact = {r[0]: r.n for r in df.groupBy(*group).agg(F.countDistinct("v").alias("n")).collect()}
        got = {r[0]: r.n_distinct for r in ag.merged_distinct(stored, group).collect()}
        assert got.keys() == exact.keys()
        assert all(abs(got[k] - exact[k]) <= max(1, 5 * 0.0065 * exact[k]) for k in exact)


def test_kept_frames_are_released(spark):
    from litspark import session
    session.release()
    df = session.reuse(spark.range(10))
    assert df.count() == 10 and df.is_cached
    assert session.release() == 1 and not df.is_cached and session.release() == 0


def test_nearest_references_meet_blocks_as_matrices(spark):
    """A row meets a block in one call, whatever the number of pairs; ties, null
    components, unlike lengths and NaN are as in a comparison of each pair."""
    refs = pa.table({"r": pa.array([4, 1, 3, 2, 9], pa.int64()), "w": pa.array([[0, 2], [2, 0], [5, 5], [0, 0], [float("nan"), 0]], pa.list_(pa.float32()))})
    rows = pa.table({"id": pa.array([1, 7], pa.int64()), "v": pa.array([[0, 0], [9, 9]], pa.list_(pa.float32())), "_bound": pa.array([None, 6.0], pa.float64())})
    schema = pa.schema([("id", pa.int64()), ("_kth", pa.float64()), ("d", pa.float64()), ("rid", pa.int64())])  # row, k-th distance, distance, reference
    run = lambda *a: vx._nearest_in_block("id", "v", "r", "w", [], *a, schema)(rows, refs).to_pylist()
    assert [(x["id"], x["rid"], x["_kth"]) for x in run(3, False)] == [(1, 2, 2.0), (1, 1, 2.0), (1, 4, 2.0), (7, 3, None)]
    assert [(x["id"], x["rid"]) for x in run(3, True)] == [(1, 2), (1, 4), (1, 3), (7, 3)]
    odd = refs.set_column(1, "w", pa.array([[0, 2], [2, None], [5], [0, 0], [float("nan"), 0]], pa.list_(pa.float32())))
    assert [(x["rid"], x["d"]) for x in vx._nearest_in_block("id", "v", "r", "w", [], 4, False, schema)(rows.slice(0, 1), odd).to_pylist()] == [
        (1, None), (3, None), (2, 0.0), (4, 2.0)]


def test_phrase_candidates_do_not_carry_their_sentence(spark):
    """A pair is a row of its words, not a copy of the sentence; without a pair a
    sentence has no row."""
    df = spark.createDataFrame([(1, ["a", "of", "b", "c"]), (2, []), (3, ["a"]), (4, ["of", "the"]), (5, None), (6, ["a", None, "b"])], "k int, toks array<string>")
    got = terms.sentence_pairs(df, "toks", ["of", "the"])
    assert got.columns == ["k", "i", "j", "a", "b", "phrase"]
    assert [tuple(r) for r in got.where("k < 6").orderBy("k", "i").collect()] == [(1, 1, 3, "a", "b", "a_of_b"), (1, 3, 4, "b", "c", None)]
    assert [r.phrase for r in terms.phrase_of(got.where("k = 1")).orderBy("i").collect()] == ["a_of_b", "b_c"]


def test_rare_pairs_meet_no_word_counts(spark):
    """Pairs counted at most min_count times cannot score above a threshold of 0
    or more: they are counted for N, and not joined."""
    df = spark.createDataFrame([(["x", "y"],)] * 4 + [(["x", "z"],), (["y", "z"],)], "toks array<string>")
    brute = {"x_y": (4 - 1) * 6 / (5 * 5), "x_z": 0.0, "y_z": 0.0}  # N: 3 words, 3 phrases
    for threshold in (0.0, -1.0):
        got = {r.phrase: r.score for r in terms.learn_phrases(df, 1, threshold).collect()}
        assert got == {p: s for p, s in brute.items() if s > threshold}


def test_mean_of_terms_sends_vectors_in_slices(spark, monkeypatch):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 3), (None, "a", 1), (3, "q", 1)], "doc_id int, term string, tf long")
    words = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [4.0, 3.0]), ("c", 2, [0.0, 5.0])], "term string, vec_id long, embedding array<float>")
    for sent in (vx.SENT_BYTES, 8):
        monkeypatch.setattr(vx, "SENT_BYTES", sent)
        out = vx.mean_of_terms(counts, words, ["doc_id"], "term", "tf", 2)
        assert {r.doc_id: (r.n, r.mean_vector) for r in out.collect()} == {1: (3.0, [2.0, 1.0]), 2: (3.0, [0.0, 5.0]), None: (1.0, [1.0, 0.0])}
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert vx.mean_of_terms(counts, words.limit(0), ["doc_id"], "term", "tf", 2).count() == 0
