"""Reproducible sampling and resampling (SMP*).

One rule replaces every random draw: rows are ordered by
``md5(seed || ':' || key)`` (ties by key). Hashes are uniform, so the first n of
N rows lie below about n / N of the hash range: a threshold a little above that
is tried first and raised until every group has enough rows below it. Only those
rows are ranked: no sort of the whole table, no single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.operators.aggregates import join_null_safe
from litspark.operators.windows import global_rank


#: Hash integers are below this (13 hex digits).
HASH_RANGE = 1 << 52
#: Up to this many rows asked for, a group's candidates are ranked in one window.
WINDOW_ROWS = 100_000


def hash_str(seed, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_int(seed, key: Column, digits: int = 13) -> Column:
    """First ``digits`` hex digits of the md5 order key as a non-negative long."""
    return F.conv(F.substring(hash_str(seed, key), 1, digits), 16, 10).cast("long")


def first_n_by_hash(df: DataFrame, n, key: str, seed, group: list[str] | None = None) -> DataFrame:
    """Exactly the first n rows per group in hash order (ties by key; a null key comes first; the null
    group is a group); n is an int or a per-group Column already on ``df``."""
    from litspark.session import small_result
    g = group or ["all__"]
    d = (df if group else df.withColumn("all__", F.lit(0))).withColumn("_h", F.coalesce(hash_int(seed, F.col(key)), F.lit(0)))
    want = F.lit(n) if isinstance(n, int) else F.first(n)
    groups = small_result(d.groupBy(*g).agg(F.count(F.lit(1)).alias("_rows"), want.cast("long").alias("_want"))
                          .withColumn("_want", F.greatest(F.least("_want", "_rows"), F.lit(0))))  # one row per group
    slack = 64
    while True:
        share = (F.col("_want") + F.lit(6) * F.sqrt("_want") + F.lit(slack)) / F.col("_rows")
        limit = F.least(F.ceil(share * F.lit(float(HASH_RANGE))), F.lit(HASH_RANGE)).cast("long")
        below = small_result(join_null_safe(d, groups.select(*g, "_want", limit.alias("_limit")), g)
                             .where((F.col("_h") < F.col("_limit")) & (F.col("_want") > 0)))  # little more than what is wanted
        have = below.groupBy(*g).agg(F.count(F.lit(1)).alias("_have"))
        short = join_null_safe(groups.where("_want > 0"), have, g, "left").where(F.coalesce("_have", F.lit(0)) < F.col("_want"))
        if short.isEmpty():
            break
        slack *= 64  # a threshold of the whole range always suffices
    if isinstance(n, int) and n <= WINDOW_ROWS:  # the rows asked for fit one task per group
        w = Window.partitionBy(*g).orderBy("_h", key)
        ranked = below.withColumn("_pos", F.row_number().over(w))
    else:
        ranked = global_rank(below, [F.col("_h"), F.col(key)], g, "_pos")
    out = ranked.where(F.col("_pos") <= F.col("_want")).drop("_h", "_want", "_limit", "_pos")
    return out if group else out.drop("all__")


def shuffle_rank(df: DataFrame, key: str, seed, partition: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based position in hash order (per partition key)."""
    return global_rank(df, [hash_str(seed, F.col(key)), F.col(key)], partition, name)


def stratified_equal(df: DataFrame, strat: str, n_samples: int, key: str, seed, cut_seed) -> DataFrame:
    """n = min(n_samples, smallest stratum) rows per stratum, then at most
    n_samples overall."""
    smallest = df.groupBy(strat).count().agg(F.min("count")).first()[0] or 0
    per = first_n_by_hash(df, int(min(n_samples, smallest)), key, seed, [strat])
    return first_n_by_hash(per, n_samples, key, cut_seed)


def composed_sample(pools: list[tuple[str, DataFrame, float]], stratify: list[str], size: int, key: str, seed, cut_seed) -> DataFrame:
    """(pool, stratum, key): from every pool (name, rows, share) and stratify
    column ``int(size * share) / len(stratify)`` rows, an equal draw over the
    column's values; a row drawn for two columns or pools is there twice."""
    out = None
    from litspark.session import cut_lineage
    for name, rows, share in pools:
        rows = cut_lineage(rows.select(key, *stratify))  # read by every draw
        quota = int(size * share) // len(stratify)
        for column in stratify:
            got = stratified_equal(rows.select(key, column), column, quota, key, seed, cut_seed).select(
                F.lit(name).alias("pool"), F.lit(column).alias("stratum"), key)
            out = got if out is None else out.unionByName(got)
    return out


def oversample(df: DataFrame, label: str, minority, ratio: float, key: str, seed) -> DataFrame:
    """Random oversampling of the minority class to ``ratio`` x majority: the
    originals plus draws i = 0..m-1, where draw i takes the minority row at
    position (first 8 hex digits of md5(seed:i)) mod n_min in hash order."""
    counts = dict(df.groupBy(label).count().collect())  # one row per class
    n_min = counts.get(minority, 0)
    n_maj = max((v for k, v in counts.items() if k != minority and k is not None), default=0)
    need = int(ratio * n_maj) - n_min
    base = df.withColumn("draw", F.lit(-1).cast("long"))
    if need <= 0 or n_min == 0:
        return base
    mino = shuffle_rank(df.where(F.col(label) == F.lit(minority)), key, seed, name="_pos")
    draws = df.sparkSession.range(need).select(
        F.col("id").alias("draw"),
        (F.conv(F.substring(hash_str(seed, F.col("id")), 1, 8), 16, 10).cast("long") % n_min + 1).alias("_pos"))
    extra = draws.join(mino, "_pos").drop("_pos")
    return base.unionByName(extra.select(*base.columns))


def smote(df: DataFrame, label: str, minority, ratio: float, key: str, vec: str, k: int, seed) -> DataFrame:
    """(synth_id, vector) of the synthetic minority rows that bring the class to
    ``ratio`` x majority: row i lies between minority row pos(i) and its j(i)-th
    nearest minority neighbour (Euclidean, ties by key) at weight w(i); pos, j
    and w come from md5(seed:i). Neighbours are found block by block."""
    from litspark.operators.vectors import nearest_references
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
    n_min = counts.get(minority, 0)
    need = int(ratio * max((v for c, v in counts.items() if c != minority and c is not None), default=0)) - n_min
    rows = shuffle_rank(df.where(F.col(label) == F.lit(minority)).select(key, vec), key, seed, name="pos")
    refs = rows.select(F.col(key).alias("_id"), F.col(vec).alias("_vec"), F.xxhash64(vec).alias("_which"))  # vectors under one key are told apart
    near = nearest_references(rows, key, vec, refs, "_id", "_vec", ["_which"], k, exclude_self=True)
    ids = near.select(key, F.posexplode("nearest").alias("j", "s")).select(key, (F.col("j") + 1).alias("j"), F.col("s.id").alias("_id"), "s._which")
    # of a neighbour only its key and the hash of its vector travel until it is drawn
    pairs = rows.select("pos", key, vec).join(ids, key).join(refs.distinct(), ["_id", "_which"]).select("pos", vec, "j", "_vec")
    h = hash_str(seed, F.col("id"))
    draws = df.sparkSession.range(max(need, 0) if n_min else 0).select(
        F.col("id").alias("synth_id"),
        (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % max(n_min, 1) + 1).alias("pos"),
        (F.conv(F.substring(h, 9, 8), 16, 10).cast("long") % min(k, max(n_min - 1, 1)) + 1).cast("int").alias("j"),
        (F.conv(F.substring(h, 17, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)).alias("w"))
    between = F.zip_with(vec, "_vec", lambda a, b: a.cast("double") + F.col("w") * (b.cast("double") - a.cast("double")))
    return draws.join(pairs, ["pos", "j"]).select("synth_id", between.alias("vector"))


def undersample(df: DataFrame, label: str, majority, ratio: float, key: str, seed) -> DataFrame:
    """Keep int(n_min / ratio) majority rows (first in hash order) and every
    other row."""
    counts = dict(df.groupBy(label).count().collect())
    n_min = min((v for k, v in counts.items() if k != majority and k is not None), default=0)
    keep = int(n_min / ratio)
    maj = first_n_by_hash(df.where(F.col(label) == F.lit(majority)), keep, key, seed)
    return df.where(~F.col(label).eqNullSafe(F.lit(majority))).unionByName(maj)


def split_train_validation(df: DataFrame, test_size: float, key: str, seed) -> DataFrame:
    """'validation' for the first ceil(test_size * n) rows in hash order."""
    import math
    n = df.count()
    k = math.ceil(test_size * n)
    r = shuffle_rank(df, key, seed, name="_pos")
    return r.withColumn("split", F.when(F.col("_pos") <= k, F.lit("validation")).otherwise(F.lit("train"))).drop("_pos")


def kfold(df: DataFrame, k: int, key: str, seed, stratify: str | None = None, name: str = "fold") -> DataFrame:
    """(position - 1) % k in hash order, per stratum when ``stratify``."""
    r = shuffle_rank(df, key, seed, [stratify] if stratify else None, name="_pos")
    return r.withColumn(name, ((F.col("_pos") - 1) % k).cast("int")).drop("_pos")
