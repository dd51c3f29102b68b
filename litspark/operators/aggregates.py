"""Aggregates: proportions, percentiles, histograms, moments (AGG*).

Every aggregate here is a ``groupBy`` whose partial aggregate runs map-side,
so a hot group costs one partial row per map task, never a whole group in one
task. Exact percentiles use a two-pass histogram refinement instead of
``percentile`` (which would hold every distinct value of a group in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def yearly_proportion(base: DataFrame, category: DataFrame, year: str = "year") -> DataFrame:
    """Per year in ``base``: category rows / base rows, 0 for years without
    category rows."""
    b = base.groupBy(year).agg(F.count(F.lit(1)).alias("n_base"))
    c = category.groupBy(year).agg(F.count(F.lit(1)).alias("n_category"))
    j = b.join(c, year, "left").withColumn("n_category", F.coalesce("n_category", F.lit(0)))
    return j.withColumn("proportion", F.col("n_category") / F.col("n_base"))


def _ranks(n: Column, p: Column):
    h = (n - F.lit(1)).cast("double") * p
    return F.floor(h).cast("long"), F.ceil(h).cast("long"), h - F.floor(h)


def join_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; the keys of ``a`` are kept."""
    r = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(r[f"_k_{k}"])
    return a.join(r, cond, how).drop(*[f"_k_{k}" for k in keys])


def values_at_ranks(df: DataFrame, value: str, group: list[str], targets: DataFrame) -> DataFrame:
    """The values at 0-based ascending ranks: ``targets`` is (group..., _r); the
    result adds ``_val``. A null group is a group; null and NaN values are left
    out. Equal values are counted before the sort, so a frequent value is one
    row; sorted ranges are summed on their own and shifted by the totals before
    them (one row per group and range)."""
    from litspark.session import cut_lineage
    g = group
    counts = (df.select(*g, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
              .groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_c")))
    s = cut_lineage(counts.orderBy(*g, "_v").withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid", *g).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)  # one range of one group
    s = s.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shift = (s.groupBy("_pid", *g).agg(F.sum("_c").alias("_total"))
             .select("_pid", *g, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift")))
    at = join_null_safe(s, shift, ["_pid", *g]).withColumn("_from", F.col("_in") + F.col("_shift")) if g else \
        s.join(shift, "_pid").withColumn("_from", F.col("_in") + F.col("_shift"))
    t = targets.select(*[F.col(k).alias(f"_t_{k}") for k in g], "_r")
    cond = (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_from") + F.col("_c"))
    for k in g:
        cond = cond & at[k].eqNullSafe(t[f"_t_{k}"])
    return at.join(t, cond).select(*g, "_r", F.col("_v").alias("_val"))


def exact_percentiles(df: DataFrame, value: str, group: list[str], probs: list[float]) -> DataFrame:
    """(group..., p, value) with linear interpolation between order statistics
    (numpy's default). The null group is a group; null values are left out."""
    if not group:
        return exact_percentiles(df.withColumn("all__", F.lit(0)), value, ["all__"], probs).drop("all__")
    g = group
    v = F.col(value).cast("double")
    n = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    need = n.select(*g, "_n", ps)
    r0, r1, frac = _ranks(F.col("_n"), F.col("p"))
    need = need.select(*g, "p", r0.alias("r0"), r1.alias("r1"), frac.alias("frac"))
    # several probabilities can need the same order statistic: resolve each once
    ranks = need.select(*g, F.explode(F.array("r0", "r1")).alias("_r")).distinct()
    from litspark.session import small_result
    found = small_result(values_at_ranks(df, value, g, ranks))  # one row per needed rank
    lo = found.select(*g, F.col("_r").alias("r0"), F.col("_val").alias("v0"))
    hi = found.select(*g, F.col("_r").alias("r1"), F.col("_val").alias("v1"))
    out = join_null_safe(join_null_safe(need, lo, [*g, "r0"]), hi, [*g, "r1"])
    return out.select(*g, "p", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")).alias("value"))


def histogram(df: DataFrame, value: str, n_bins: int, group: list[str] | None = None) -> DataFrame:
    """Equal-width bins between min and max (max falls in the last bin)."""
    g = group or []
    v = F.col(value).cast("double")
    if g:
        rng = df.groupBy(*g).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))  # one row per group
        d = df.join(rng, g)
    else:
        d = df.withColumn("_lo", df.agg(F.min(v)).scalar()).withColumn("_hi", df.agg(F.max(v)).scalar())
    width = (F.col("_hi") - F.col("_lo")) / F.lit(n_bins)
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((v - F.col("_lo")) / width), F.lit(n_bins - 1)))
    h = d.groupBy(*g, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"),
                                                      F.first("_lo").alias("lo"), F.first("_hi").alias("hi"))
    return h.select(*g, "bin", "count", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / n_bins).alias("left"))


def skewness_corrected(c: str) -> Column:
    """Sample skewness with the bias correction (pandas ``skew``); NULL for
    fewer than three values (and for a constant column, whose skewness is undefined)."""
    n = F.count(c).cast("double")
    return F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2)


#: Sketches of distinct counts have 2^HLL_BITS registers; the relative standard
#: error of an estimate is about 0.83 / 2^(HLL_BITS / 2), here 0.65 %.
HLL_BITS = 14


def distinct_sketches(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group..., sketch): a mergeable sketch of the distinct values of a group, a
    few kilobytes however many there are. Null values are not counted."""
    return df.groupBy(*group).agg(F.hll_sketch_agg(value, HLL_BITS).alias("sketch"))


def merged_distinct(sketches: DataFrame, group: list[str]) -> DataFrame:
    """(group..., n_distinct): estimates of any coarser slice from the stored
    sketches, without reading a value again."""
    return sketches.groupBy(*group).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def coded_sets(sets: dict[str, DataFrame], score: float = 1.0) -> DataFrame:
    """SET6: the rows of all sets with ``coded_set`` and a ``<name>_score`` each:
    the constant for the set's own perspective, null for the others."""
    out = None
    for name, rows in sets.items():
        scores = [F.lit(score if other == name else None).cast("double").alias(f"{other}_score") for other in sets]
        rows = rows.select("*", F.lit(name).alias("coded_set"), *scores)
        out = rows if out is None else out.unionByName(rows)
    return out
