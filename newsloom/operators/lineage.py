"""Reliable checkpoints, and folders for what operators write themselves."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where none is named and all runs on this machine."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf = context.getConf()
    if not conf.contains("spark.checkpoint.dir") and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(conf.get("spark.checkpoint.dir") if conf.contains("spark.checkpoint.dir") else tempfile.mkdtemp(prefix="newsloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: what is read twice afterwards is the same rows in the same partitions.

    Its files go when the session no longer holds them, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


_WRITTEN: list[tuple[weakref.ref, str]] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes with ``release_written`` or when the process ends."""
    path = f"{shared_folder(spark).rstrip('/')}/newsloom-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((weakref.ref(spark), path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as compressed columns and read back: a tenth of a checkpoint's rows, often less.

    Lineage is cut and the rows stay as they are; their order and partitions are not kept.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    df.write.options(compression="zstd", **{"parquet.block.size": str(16 << 20)}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_written() -> None:
    """Delete what operators wrote; only for callers that have written all results which read it."""
    while _WRITTEN:
        ref, path = _WRITTEN.pop()
        spark = ref()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended: nothing can be deleted through it
            continue


atexit.register(release_written)
