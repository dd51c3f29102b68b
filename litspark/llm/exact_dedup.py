"""Exact duplicates of an incoming batch against an immutable snapshot.

The snapshot's digests are split by digest into shards of bounded size; one
static binary-fuse filter is built per shard (``build_filters``).  The batch's
distinct digests are screened by the filter of their shard: a negative is
certainly new and needs no look-up.  Positives join the exact bucket of their
digest in the snapshot, and one text of either side is compared byte by byte.
Copies inside the batch are grouped on their own, by digest.

Digest rows carry no text.  Equal texts are pre-aggregated before every
shuffle, so a text that makes up a third of all rows costs one row per task.

Defined cases: null text is empty; empty texts equal each other; rows that
repeat a doc_id and a text are one group (both rows are returned, and
``drop_copies`` keeps a single one); a null doc_id sorts behind all others; an
empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm import fuse_filter
from litspark.llm.common import checkpointed, table, text_of

#: Digests that one filter shard holds on average; a shard is one task's work.
SHARD_KEYS = 200_000
#: Candidate pairs whose ids are sent to the texts; more meet them by hash.
BROADCAST_PAIRS = 100_000


def normalised(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sha (binary), size (normalised bytes), n (code points of the
    original), key (64-bit digest for filters and buckets): the only pass over
    the texts."""
    text = text_of(text_col)
    return (docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
            .select("doc_id", F.length("t").cast("long").alias("n"), normalised(F.col("t")).alias("m"))
            .select("doc_id", "n", F.unhex(F.sha2(F.col("m"), 256)).alias("sha"),
                    F.octet_length("m").cast("long").alias("size"), F.xxhash64("m").alias("key")))


def _better(doc_id: str = "doc_id") -> Column:
    """Orders the rows of a group: most code points, then smallest doc_id; nulls last."""
    return F.struct((-F.col("n")).alias("less"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per distinct text: the row that stays and how many there are."""
    return rows.groupBy("key", "sha", "size").agg(F.count(F.lit(1)).alias("rows"), F.min(_better()).alias("best"))


def _shard(n_shards: int) -> Column:
    return F.pmod(F.xxhash64(F.col("key"), F.lit(17)), F.lit(n_shards)).cast("int")


def shards_for(*sides: DataFrame) -> int:
    """Shards by the larger side: a task builds a filter or looks keys up in one."""
    return max(1, *(-(-groups.count() // SHARD_KEYS) for groups in sides))


def build_filters(groups: DataFrame, n_shards: int) -> DataFrame:
    """(shard, filter) of a snapshot, whose distinct texts are ``groups``."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]],
                             "filter": [fuse_filter.build(pdf["key"].to_numpy().view(np.uint64))]})

    return (groups.select("key").distinct().select("key", _shard(n_shards).alias("shard"))
            .groupBy("shard").applyInPandas(build, "shard int, filter binary"))


def screen(groups: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
    """The keys among the batch's ``groups`` that a filter reports as possibly known."""
    def look(batch: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        seen = fuse_filter.probe(held["filter"].iloc[0] if len(held) else None, batch["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"key": batch["key"].to_numpy()[seen]})

    keys = groups.select("key").distinct().select("key", _shard(n_shards).alias("shard"))
    return keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(look, "key bigint")


def known(batch: DataFrame, snapshot: DataFrame, batch_docs: DataFrame, snapshot_docs: DataFrame) -> DataFrame:
    """Batch groups whose text the snapshot really has: candidates of equal key
    and digest, then the bytes of one text of either side."""
    filters = checkpointed(build_filters(snapshot, n := shards_for(snapshot, batch)))
    maybe = screen(batch, filters, n)
    pairs = checkpointed(
        batch.join(maybe, "key", "left_semi").select("key", "sha", "size", F.col("best.id").alias("b_id"), F.col("best.less").alias("b_less"))
        .join(snapshot.select("key", "sha", "size", F.col("best.id").alias("s_id"), F.col("best.less").alias("s_less")), ["key", "sha", "size"]))

    few = pairs.count() <= BROADCAST_PAIRS

    def of(docs: DataFrame, id_: str, less: str, name: str) -> DataFrame:
        texts = docs.select(F.col("doc_id").alias(id_), F.length(text_of()).cast("long").alias("len"), normalised(text_of()).alias(name))
        ids = pairs.select(id_, F.col(less), "key", "sha", "size")
        ids = F.broadcast(ids) if few else ids  # no text but the candidates' moves then
        return (ids.join(texts, ids[id_].eqNullSafe(texts[id_]) & (F.col("len") == -F.col(less)) & (F.xxhash64(name) == F.col("key")))
                .select("key", "sha", "size", name))

    # repeated rows of one id give the same bytes several times: any match will do
    return (of(batch_docs, "b_id", "b_less", "ours").join(of(snapshot_docs, "s_id", "s_less", "theirs"), ["key", "sha", "size"])
            .filter(F.col("ours") == F.col("theirs")).select("key", "sha", "size").distinct())


def exact_dedup(snapshot_docs: DataFrame, batch_docs: DataFrame) -> DataFrame:
    """Every row of both: doc_id, n, text_sha256, keep_id, group_size, kept and
    best_rows (rows that equal the keeper in id, text and length)."""
    rows = checkpointed(digests(snapshot_docs).withColumn("incoming", F.lit(False))
                        .unionByName(digests(batch_docs).withColumn("incoming", F.lit(True))))
    snapshot = grouped(rows.filter(~F.col("incoming")))
    batch = grouped(rows.filter("incoming"))
    matched = known(batch, snapshot, batch_docs, snapshot_docs)
    # Groups of one text merge where the bytes were found equal; a batch group
    # without a match stays by itself.
    key = ["key", "sha", "size"]
    fresh = batch.join(matched, key, "left_anti").withColumn("alone", F.lit(True))
    merged = (snapshot.unionByName(batch.join(matched, key, "left_semi")).groupBy(*key)
              .agg(F.sum("rows").alias("rows"), F.min("best").alias("best")).withColumn("alone", F.lit(False)))
    verdicts = merged.unionByName(fresh)
    # A row belongs to the merged group, or to the one that stands alone (only
    # batch rows can); with equal digests of unequal bytes both exist.
    # Written, so that the join below deals both sides out for itself and a hot
    # text's rows can be split.
    both = checkpointed(verdicts.groupBy(*key).agg(F.max(F.when(F.col("alone"), F.struct("rows", "best"))).alias("own"),
                                                   F.max(F.when(~F.col("alone"), F.struct("rows", "best"))).alias("shared")))
    chosen = F.when(F.col("incoming") & F.col("own").isNotNull(), F.col("own")).otherwise(F.col("shared"))
    out = rows.join(both, key).select("doc_id", "n", "sha", chosen.alias("g"))
    return out.select("doc_id", "n", F.lower(F.hex("sha")).alias("text_sha256"), F.col("g.best.id").alias("keep_id"),
                      F.col("g.rows").alias("group_size"),
                      (F.col("doc_id").eqNullSafe(F.col("g.best.id")) & (-F.col("n") == F.col("g.best.less"))).alias("kept"))


def split_by_id(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A table seen as a snapshot (even digest of the id) and a batch."""
    odd = F.pmod(F.xxhash64(F.col(id_col), F.lit(6)), F.lit(2)) == 1
    return docs.filter(~odd), docs.filter(odd)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    verdicts = checkpointed(exact_dedup(*split_by_id(docs)).filter("kept").groupBy("doc_id", "n", "text_sha256").agg(F.count(F.lit(1)).alias("same")))
    text = text_of()
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("id_"),
                        F.length(text).cast("long").alias("n_"), F.sha2(normalised(text), 256).alias("sha_"))

    def picked(some: DataFrame) -> DataFrame:
        return keyed.join(some, keyed["id_"].eqNullSafe(some["doc_id"]) & (keyed["n_"] == some["n"]) & (keyed["sha_"] == some["text_sha256"]), "left_semi")

    kept, again = picked(verdicts.filter("same = 1")), verdicts.filter("same > 1")
    if not again.isEmpty():  # rows that repeat an id and a text: one of them
        kept = kept.unionByName(picked(again).dropDuplicates(["id_", "sha_"]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(*split_by_id(docs)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
