"""Ranking, top-k, nearest-k and positional slices (WIN*, SET* helpers).

A top-k is a ``row_number() <= k`` filter over a window: Spark limits every map
task to k rows per group before the exchange, so a group of any size sends at
most k rows per task. Ranks over whole groups, and first-n for any n, use
``global_rank``: a range sort over the cluster and partition offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.operators.aggregates import join_null_safe
from litspark.session import cut_lineage


def top_k(df: DataFrame, group: list[str], score: Column, k: int, ties: list[Column],
          descending: bool = True, rank_name: str = "rank") -> DataFrame:
    """The k best rows per group by ``score`` (null scores last, ties broken by
    ``ties``), with a 1-based rank. The null group is a group."""
    order = score.desc_nulls_last() if descending else score.asc_nulls_last()
    w = Window.partitionBy(*group).orderBy(order, *ties)
    return df.withColumn(rank_name, F.row_number().over(w).cast("int")).where(F.col(rank_name) <= k)


def nearest_k(df: DataFrame, value: Column, center: Column, group: list[str], k: int, id_col: str,
              rank_name: str = "rank", digits: int = 9) -> DataFrame:
    """k rows nearest to ``center`` per group (ties by id). Distances are
    rounded to ``digits`` places so that mathematically equal distances (two
    rows either side of an interpolated median) tie and fall to the id."""
    d = df.withColumn("_dist", F.round(F.abs(value - center), digits))
    return top_k(d, group, F.col("_dist"), k, [F.col(id_col).asc()], descending=False, rank_name=rank_name)


def global_rank(df: DataFrame, order: list[Column], partition: list[str] | None = None,
                name: str = "rank") -> DataFrame:
    """Dense 1-based position in a total order without a single-partition
    window: range-sort, fix the sorted partitions with a reliable checkpoint,
    count rows per partition (one row each), and add partition offsets to the
    position inside the partition. With ``partition`` the rank restarts per key
    (the key leads the sort; its first position is subtracted)."""
    p = partition or []
    keys = [F.col(c) for c in p] + order
    s = cut_lineage(df.orderBy(*keys).withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mono", F.monotonically_increasing_id()))
    per = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mono").alias("_m0"))
    ow = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    per = per.withColumn("_off", F.coalesce(F.sum("_cnt").over(ow), F.lit(0)))
    r = s.join(F.broadcast(per.select("_pid", "_off", "_m0")), "_pid") \
        .withColumn(name, F.col("_off") + F.col("_mono") - F.col("_m0") + 1)
    if p:
        first = r.groupBy(*p).agg(F.min(name).alias("_first"))  # one row per key
        r = join_null_safe(r, first, p).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
    return r.drop("_pid", "_mono", "_off", "_m0")


def positional_slice(df: DataFrame, order: list[Column], start: int, stop: int,
                     partition: list[str] | None = None) -> DataFrame:
    """Rows at 0-based positions [start, stop) of the ordered frame (per key)."""
    r = global_rank(df, order, partition, name="_pos")
    return r.where((F.col("_pos") > start) & (F.col("_pos") <= stop)).withColumn("position", F.col("_pos") - 1).drop("_pos")


def first_n(df: DataFrame, n: int, score: Column, tie: Column, name: str = "rank") -> DataFrame:
    """The n rows with the largest ``score`` (null scores last, ties by ``tie``
    ascending) and their 1-based rank, for any n: sorted by range over the
    cluster. Unlike ``orderBy().limit(n)`` no single task merges n rows from
    every partition."""
    d = df.withColumn("_key", score)
    return global_rank(d, [F.col("_key").desc_nulls_last(), tie.asc()], name=name).where(F.col(name) <= n).drop("_key")
