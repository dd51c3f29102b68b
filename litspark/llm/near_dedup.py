"""Near duplicates by bottom-k sketches of word shingles.

One hash function orders all shingles; a document keeps its K smallest hashes.
Inverted lists of retained values generate overlaps: two sets of similarity
0.75 share 48 of 64 retained values on average, and 30 or more but for one pair
in a million, so each document need only list its K-30+1 rarest values (a
prefix in the order of rarity; sets of at most 48 shingles are kept whole and
their bound is exact). Values that a common passage spreads over the corpus are
thereby not listed. The estimate from the union's sketch drops pairs far below
the threshold, and the exact Jaccard of the full sets decides every link.

Documents with equal sets (by size and two 64-bit digests) form one class and are
linked without any pair.
Inside a long list pairs are not enumerated: its most central class is compared
with all others first, components are formed, and only classes that are still
apart go on; what remains is compared exactly, block by block, and only links
leave the tasks. So no link between different components is lost, and a family of near copies that is a third of
all rows costs a few links per member. Before that, the full sets tell exactly
which candidates can have a partner at all: one of whose shingles more than a
quarter are in no other candidate cannot (heavily edited copies go here), and
neither can a pair whose shared shingles are too few for its sizes.

Defined cases: null or empty texts and texts without a word have an empty set
and are linked with nothing; fewer than five words are one shingle; a repeated
row shares its class; a null doc_id takes its class's component (null if the
class has no id); an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm.common import checkpointed, shared_folder, slices, small_batches, table, text_of
from litspark.llm.components import components
from litspark.llm.words import BLANK_SEPARATED, mix, shingle_sets, split_words
from litspark.operators.windows import global_rank

WIDTH = 5
K = 64
#: Retained values that two linked sets share at least (see above).
SHARED = 30
WHOLE = 48
PERCENT = 75
#: Five standard deviations of the union-sketch estimate below the threshold.
ESTIMATE = 0.75 - 5 * (0.75 * 0.25 / K) ** 0.5
STAR_ROUNDS = 2
#: Bits per candidate that tell other documents from them: one in BITS passes.
BITS = 16
#: Listed entries that one task handles once few are left.
TASK_ENTRIES = 50_000
#: Classes of a block, when what is left apart is compared.
BLOCK = 64
#: Pairs (two numbers each) that are sent to every task at most.
BROADCAST_PAIRS = 100_000


def _ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    one = [np.bitwise_xor.reduce(mix(s)) if len(s) else np.uint64(0) for s in sets]
    two = [np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else np.uint64(0) for s in sets]
    return np.array(one, np.uint64).view(np.int64), np.array(two, np.uint64).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(offsets, flat)


def _scan(keep: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            sets = [s >> np.uint64(1) for s in shingle_sets(split_words(data, offsets, BLANK_SEPARATED), WIDTH)]
            h1, h2 = _ids(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2),
                 _lists([s[:keep] for s in sets])], ["doc_id", "n", "h1", "h2", "hashes"])
    return run


_SCHEMA = "doc_id bigint, n bigint, h1 bigint, h2 bigint, hashes array<bigint>"


def sketches(docs: DataFrame, keep: int | None = K) -> DataFrame:
    small_batches(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
            .mapInArrow(_scan(keep), _SCHEMA).withColumn("node", _node(0)))


def _node(seed: int) -> Column:
    return F.xxhash64("n", "h1", "h2") if not seed else F.xxhash64("n", "h1", "h2", F.lit(seed))


def shared_nodes(rows: DataFrame) -> DataFrame:
    """The numbers that sets of different size or digests share by chance."""
    both = F.struct("n", "h1", "h2")
    return rows.filter("n > 0").groupBy("node").agg(F.min(both).alias("a"), F.max(both).alias("b")).filter("a != b").select("node")


def _renumbered(rows: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    hit = F.broadcast(nodes.withColumnRenamed("node", "hit"))  # pairs that meet in 64 bits: a handful among 10^10 sets
    return rows.join(hit, F.col("node") == F.col("hit"), "left").withColumn("node", F.when(F.col("hit").isNull(), F.col("node")).otherwise(_node(seed))).drop("hit")


def named_apart(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with one number per set, told apart by size and both digests: a
    number that two sets share is drawn anew. And the numbers that were."""
    rounds: list[DataFrame] = []
    while not (found := checkpointed(shared_nodes(rows))).isEmpty():
        rounds.append(found)
        rows = checkpointed(_renumbered(rows, found, len(rounds)))
    return rows, rounds


def _least_shared(n: Column) -> Column:
    return F.when(n <= WHOLE, F.ceil(n * PERCENT / 100)).otherwise(SHARED)


def listings(classes: DataFrame) -> DataFrame:
    """The inverted lists: (value, node, n) of the rarest retained values of
    each class, values held by one class only left out."""
    each = classes.select("node", "n", F.explode("hashes").alias("value"))
    common = each.groupBy("value").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    held = (each.join(common, "value").groupBy("node", "n")
            .agg(F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("held")))  # at most K entries
    k = F.least("n", F.lit(K))
    own = k - F.size("held")  # values no other class holds are the rarest
    rarest = held.withColumn("take", (k - _least_shared(F.col("n")) + 1 - own).cast("int")).filter("take > 0")
    return (rarest.select("node", "n", F.explode(F.slice("held", 1, F.col("take"))).alias("h"))
            .select(F.col("h.value").alias("value"), "node", "n"))


def reachable(sets: DataFrame) -> DataFrame:
    """(node, s) of the candidates that can have a partner at all: s of their n
    shingles are in another candidate's set, and a link needs three quarters.
    A value with a single holder names it, so holders are not joined back."""
    each = sets.select("node", F.explode("hashes").alias("value"))
    alone = (each.groupBy("value").agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("node")).filter("holders = 1")
             .groupBy("node").agg(F.count(F.lit(1)).alias("own")))
    s = F.col("n") - F.coalesce("own", F.lit(0))
    return (sets.select("node", F.size("hashes").alias("n")).join(alone, "node", "left").select("node", "n", s.alias("s"))
            .filter(F.col("s") * 100 >= F.col("n") * PERCENT).select("node", "s"))


def likely(rows: DataFrame, key: str, ids: DataFrame, n: int) -> DataFrame:
    """The rows whose ``key`` is in ``ids`` (one column, n rows) and few others:
    one bit of BITS per id is sent to every task, so most other rows stay where
    they are. No row of ``ids`` is lost."""
    def slot(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(max(1, BITS * n)))

    marks = ids.select(slot(F.col(ids.columns[0])).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("marked"))  # 4 KB for 32,768 bits
    at = F.bitmap_bit_position(slot(F.col(key)))
    byte = F.conv(F.hex(F.substring(F.col("marked"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = (F.bitmap_bucket_number(slot(F.col(key))) == F.col("bucket")) & (F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1)
    return rows.join(F.broadcast(marks), hit, "left_semi")


def _fits() -> Column:
    """Whether two sets of sizes n, m with s, r shared shingles can reach the
    threshold: the overlap is at most min(s, r), and 0.75 needs 3/7 of n + m."""
    most = F.least("s", "r")
    return (most * (100 + PERCENT) >= (F.col("n") + F.col("m")) * PERCENT) & (most * 100 >= F.greatest("n", "m") * PERCENT)


def verified(pairs: DataFrame, sets: DataFrame, n_pairs: int) -> DataFrame:
    """Pairs (u, v) linked by the exact Jaccard of their full sets; pairs that
    the union's sketch rules out are dropped before. A few pairs (counted: at
    most BROADCAST_PAIRS) go to the sets, many are dealt out with them."""
    p = F.broadcast(pairs) if n_pairs <= BROADCAST_PAIRS else pairs
    su = sets.join(p, sets["node"] == p["u"]).select("u", "v", F.col("hashes").alias("su"))
    sv = sets.join(p, sets["node"] == p["v"]).select("u", "v", F.col("hashes").alias("sv"))
    both = (su.join(sv, ["u", "v"])
            .withColumn("ku", F.slice("su", 1, K)).withColumn("kv", F.slice("sv", 1, K))
            .withColumn("least", F.slice(F.array_sort(F.array_union("ku", "kv")), 1, K)))
    alike = both.filter(F.size(F.array_intersect(F.array_intersect("least", "ku"), F.col("kv"))) >= F.lit(ESTIMATE) * F.size("least"))
    exact = alike.withColumn("inter", F.size(F.array_intersect("su", "sv")))
    return exact.filter(F.col("inter") * 100 >= (F.size("su") + F.size("sv") - F.col("inter")) * PERCENT).select("u", "v")


def _apart(entries: DataFrame, roots: DataFrame | None, parts: int | None = None) -> DataFrame:
    """Entries, with the root of their component, of the lists that still hold
    several components; ``parts``: into how many partitions they fit."""
    fit = (lambda df: df.coalesce(parts)) if parts else (lambda df: df)
    if roots is None:
        entries = entries.withColumn("root", F.col("node"))
    else:
        entries = fit(entries.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed = entries.groupBy("value").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("value")
    return fit(entries.join(fit(mixed), "value"))


def _hub_pairs(entries: DataFrame, turn: int, compared: DataFrame | None) -> DataFrame:
    """Every class with the most central class (the one with the largest share
    of common shingles) of one of its lists, of another component and not yet
    compared; odd turns take another hub of each list."""
    order = [(F.col("s") / F.col("n")).alias("central"), F.col("node"), F.col("n").alias("m"), F.col("s").alias("r"), F.col("root").alias("its")]
    if turn % 2:
        order.insert(0, F.xxhash64("root", F.lit(turn)).alias("by"))
    hub = entries.groupBy("value").agg(F.max(F.struct(*order)).alias("hub")).select("value", "hub.central", F.col("hub.node").alias("v"), "hub.m", "hub.r", "hub.its")
    pairs = (entries.join(hub, "value").filter("root != its").filter(_fits())
             .select("node", "central", F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")))
    if compared is not None:
        pairs = pairs.join(compared, ["u", "v"], "left_anti")
    best = pairs.groupBy("node").agg(F.max(F.struct("central", "u", "v")).alias("p"))
    return best.select("p.u", "p.v").distinct()


def block_links(entries: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Links (u, v) between classes of different components that share a list,
    found block by block: classes that lists hold together are laid out next to
    each other, by component, in blocks of BLOCK; a task compares two blocks and
    returns what joins their components. Two blocks of one component are not
    compared. No pair is a row, and no task holds more than two blocks."""
    least = entries.groupBy("value").agg(F.min("node").alias("v"))
    family = components(entries.join(least, "value").select(F.col("node").alias("u"), "v").coalesce(parts)).toDF("node", "family")
    nodes = entries.select("node", "n", "s", "root").distinct().join(family, "node", "left").withColumn("family", F.coalesce("family", "node"))
    placed = checkpointed(global_rank(nodes.coalesce(parts), [F.col("family"), F.col("root"), F.col("node")], name="at")
                          .withColumn("block", F.floor((F.col("at") - 1) / BLOCK)).coalesce(parts))
    reach = placed.groupBy("family").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    pure = placed.groupBy("block").agg(F.min("root").alias("one"), F.max("root").alias("other")).select(
        F.col("block").alias("with"), F.when(F.col("one") == F.col("other"), F.col("one")).alias("only"))
    own = pure.toDF("block", "own")
    met = (placed.join(reach, "family").join(own, "block").withColumn("with", F.explode(F.sequence("lo", "hi"))).join(pure, "with")
           .filter(~F.coalesce(F.col("own") == F.col("only"), F.lit(False)))
           .select("node", "n", "s", "root", "family", "block", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b")))
    return (met.coalesce(parts).join(sets.select("node", "hashes"), "node").groupBy("a", "b").applyInPandas(_compare, "u bigint, v bigint"))


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """The links of two blocks, or of one with itself, as far as they join
    components."""
    node, n, s, label, family = (rows[c].to_numpy().copy() for c in ("node", "n", "s", "root", "family"))
    sets = [np.asarray(h) for h in rows["hashes"]]
    first, second = rows["a"].iloc[0], rows["b"].iloc[0]
    block = rows["block"].to_numpy()
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    if len(right) < len(left):
        left, right = right, left
    links = []
    for i in left.tolist():
        j = right[(family[right] == family[i]) & (label[right] != label[i])]
        most = np.minimum(s[i], s[j])
        j = j[(most * (100 + PERCENT) >= (n[i] + n[j]) * PERCENT) & (most * 100 >= np.maximum(n[i], n[j]) * PERCENT)]
        if not len(j):
            continue
        flat = np.concatenate([sets[k] for k in j.tolist()])
        at = np.searchsorted(sets[i], flat)
        at[at == len(sets[i])] = 0
        inter = np.add.reduceat(sets[i][at] == flat, np.cumsum(n[j]) - n[j])
        for k in j[inter * 100 >= (n[i] + n[j] - inter) * PERCENT].tolist():
            if label[k] != label[i]:
                links.append((max(node[i], node[k]), min(node[i], node[k])))
                label[label == label[k]] = label[i]
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    shared_folder(spark)
    rows, renamed = named_apart(checkpointed(sketches(docs)))
    members = rows.select("doc_id", "n", "node")
    first = members.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    roots = spark.createDataFrame([], "node bigint, root bigint")
    entries = checkpointed(listings(_representatives(rows, first)))
    entries = checkpointed(_apart(entries, None).select("value", "node", "n"))
    if not entries.isEmpty():
        wanted = checkpointed(entries.select("node").distinct().join(first, "node"))
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
        ids = checkpointed(wanted.select("first_id").distinct())
        picked = likely(texts, "doc_id", ids, ids.count()).join(ids, F.col("first_id").eqNullSafe(F.col("doc_id")), "left_semi")
        whole = sketches(picked, None)
        for k, nodes in enumerate(renamed):
            whole = _renumbered(whole, nodes, k + 1)
        sets = checkpointed(whole.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]).select("node", "hashes"))
        entries = checkpointed(entries.join(reachable(sets), "node"))
        edges, compared, parts = None, None, None
        for turn in range(STAR_ROUNDS + 1):
            entries = checkpointed(_apart(entries, roots if turn else None, parts))
            now = entries.count()
            if not now:
                break
            parts = 1 + now // TASK_ENTRIES  # what is left is small; so are its tasks
            entries = entries.coalesce(parts)
            if turn < STAR_ROUNDS:
                pairs = checkpointed(_hub_pairs(entries, turn, compared).coalesce(parts))
                fresh = checkpointed(verified(pairs, sets, pairs.count()).coalesce(parts))
                compared = pairs if compared is None else compared.unionByName(pairs)
            else:
                fresh = checkpointed(block_links(entries, sets, parts))
            roots = components(fresh if edges is None else edges.unionByName(fresh))
            edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    named = first.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = checkpointed(named.join(lowest, "root").select("node", "component_id"))
    some = members.filter("n > 0").join(labels, "node").select("doc_id", "n", "component_id")
    none = members.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                         F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _representatives(rows: DataFrame, first: DataFrame) -> DataFrame:
    """One row per distinct non-empty set."""
    own = rows.filter("n > 0").select("node", "n", "hashes", "doc_id")
    f = first.withColumnRenamed("node", "node_")
    joined = own.join(f, (F.col("node") == F.col("node_")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    return joined.dropDuplicates(["node"]).select("node", "n", "hashes")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the smallest doc_id of each component, all columns kept.
    Rows of one doc_id stay if any of them stays."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id_")).distinct()
    return docs.join(kept, docs["doc_id"].cast("bigint").eqNullSafe(kept["kept_id_"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = None
