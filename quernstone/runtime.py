"""Session-level helpers shared by every operator."""

from __future__ import annotations

import gc
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the test tables; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, or a fresh local one where it is unset and the master is local (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(given)
        return given
    if spark.sparkContext.getCheckpointDir() is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quernstone-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


FEW = 200_000  # keys that are sent to every task, at most


def narrowed(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is among the distinct ``keys``: without a shuffle of ``df`` while the keys are few, else by a join."""
    few = keys.limit(FEW + 1).count() <= FEW
    return df.join(F.broadcast(keys) if few else keys.hint("merge"), key, "left_semi")


_kept: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """Keep ``df`` on local disk for reuse; recomputed from its lineage if an executor is lost. :func:`release` lets go of it."""
    _kept.append(df.persist(StorageLevel.DISK_ONLY))
    return _kept[-1]


def kept_now() -> int:
    return len(_kept)


def release(down_to: int = 0) -> int:
    """Let go of what is kept beyond the first ``down_to``, once the results made from it are written; how many there were."""
    n = max(0, len(_kept) - down_to)
    while len(_kept) > down_to:
        try:
            _kept.pop().unpersist()
        except Exception:  # its session has ended
            pass
    return n


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that no frame needs any more; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
