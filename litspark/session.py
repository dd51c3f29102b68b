"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "litspark", extra: dict | None = None) -> SparkSession:
    """Session for tests and local benchmarks. On a cluster, pass the cluster's
    master and a shuffle partition count sized to ~128-256 MB per partition."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("LITSPARK_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``. Without one, a local
    session gets a scratch folder and any other an error."""
    sc = spark.sparkContext
    existing = sc._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # nothing is configured in a local session, i.e. tests
        current = tempfile.mkdtemp(prefix="litspark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(current)
    return current


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor
    loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_result(df: DataFrame) -> DataFrame:
    """Materialise a small derived table (one row per group, a vocabulary, a
    phrase list) in the shared checkpoint folder. Later plans then start from a
    leaf instead of repeating the whole lineage that produced it, which keeps
    plans small when such results are reused and nested."""
    return cut_lineage(df)


_kept: list[DataFrame] = []


def reuse(df: DataFrame) -> DataFrame:
    """Keep a frame that several branches of one plan read (memory, spilling to
    disk) until ``release``. Lost blocks are recomputed from lineage, so executor
    loss is safe."""
    from pyspark import StorageLevel
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(df)
    return df


def release() -> int:
    """Give the kept frames' blocks back, once the results that read them are
    written; returns how many there were."""
    n = len(_kept)
    while _kept:
        _kept.pop().unpersist()
    return n
