"""Multi-party dialogues rendered once from every participant's side.

For each speaker of a conversation the whole dialogue is rendered with that
speaker as the assistant and everyone else as a user under their own name; a
system turn stays a system turn. The loss mask covers the assistant's words
(with the closing mark) and nothing else.

A rendering is given as one row per turn: its text, where it begins in the
rendering, and the masked stretch. Long conversations therefore need no row and
no task of their own: turns are dealt out by range of (conversation,
perspective, order), running lengths are summed inside each partition and the
partitions' totals, a few numbers per conversation that spans several, are added
in a second step. Joining the turns' texts in order gives the rendering.

Order within a conversation: turn number, then role, then text; null turn
numbers come first.

Defined cases: null text is empty (an empty message is rendered); a null or
blank role is the speaker "unknown"; repeated rows are repeated turns; a
conversation of system turns only has no participant and no rendering; null
conv_id is a conversation of its own; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark.llm.common import checkpointed, table, text_of

SYSTEM = "system"
# The marks of a rendered message.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _speaker() -> Column:
    role = F.trim(F.coalesce(F.col("role").cast("string"), F.lit("")))
    return F.when(role == "", F.lit("unknown")).otherwise(role)


def perspectives(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, speaker, segment, mask_start, mask_length):
    every turn as each participant sees it."""
    t = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), _speaker().alias("speaker"), text_of().alias("text"))
    # participants are few against turns: counted per task before the shuffle
    who = (t.filter(F.col("speaker") != SYSTEM).groupBy("conv_id", "speaker").agg(F.count(F.lit(1)).alias("_n"))
           .select(F.col("conv_id").alias("conv_id_"), F.col("speaker").alias("perspective")))
    seen = t.join(who, t["conv_id"].eqNullSafe(who["conv_id_"])).drop("conv_id_")
    mine = F.col("speaker") == F.col("perspective")
    head = F.concat(F.lit(OPEN), F.when(mine, F.lit("assistant")).when(F.col("speaker") == SYSTEM, F.lit(SYSTEM))
                    .otherwise(F.concat(F.lit("user name="), F.col("speaker"))), F.lit("\n"))
    tail = F.lit(CLOSE)
    return seen.select("conv_id", "perspective", "turn", "speaker", "text", F.concat(head, "text", tail).alias("segment"),
                       F.when(mine, F.length(head)).cast("bigint").alias("in_segment"),
                       F.when(mine, F.length("text") + len(CLOSE)).otherwise(0).cast("bigint").alias("mask_length"))


def rotated(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, segment, start, mask_start,
    mask_length; start and mask_start are code points in the whole rendering."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("perspective"), F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: the partition a row fell into must not change between the two uses
    dealt = checkpointed(perspectives(turns).withColumn("tie", F.monotonically_increasing_id())
                         .repartitionByRange(parts, *order, F.col("tie"))
                         .withColumn("part", F.spark_partition_id()).withColumn("size", F.length("segment").cast("bigint")))
    # inside a partition: running sums over at most one partition's share of a conversation
    group = ["part", "conv_id", "perspective"]
    inside = Window.partitionBy(*group).orderBy(*order[2:], "tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = (dealt.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .withColumn("rank", F.count(F.lit(1)).over(inside)))
    totals = dealt.groupBy(*group).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.col("conv_id").alias("c_"), F.col("perspective").alias("p_"),
                         F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size_before"),
                         F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    both = summed.join(base.withColumnRenamed("part", "part_"), (F.col("part") == F.col("part_")) & F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("perspective") == F.col("p_")))
    start = F.col("before") + F.col("size_before")
    return both.select("conv_id", "perspective", (F.col("rank") + F.col("rows_before")).cast("bigint").alias("position"), "turn", "speaker",
                       "segment", start.cast("bigint").alias("start"), (start + F.col("in_segment")).cast("bigint").alias("mask_start"), "mask_length")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS speaker, coalesce(text, '') AS text
  FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.conv_id, perspective, turn, speaker, text,
         '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
                                ELSE 'user name=' || speaker END || chr(10) AS head
  FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id),
s AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment,
         row_number() OVER w - 1 AS position,
         coalesce(sum(length(head) + length(text) + 11) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker, segment, CAST(start AS BIGINT) AS start,
       CASE WHEN speaker = perspective THEN CAST(start + length(head) AS BIGINT) END AS mask_start,
       CAST(CASE WHEN speaker = perspective THEN length(text) + 11 ELSE 0 END AS BIGINT) AS mask_length
FROM s
"""
