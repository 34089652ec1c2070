"""Parquet tables of a data folder, and the one place that says how they are read."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns not selected later are not read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blank_safe(column: str) -> F.Column:
    """Null as the empty string, so that hashing and comparing stay total."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: the one ``spark.checkpoint.dir`` names.

    Only in one process, as in tests, a folder beside the warehouse does where none is named;
    on a cluster that is an error, never a folder of one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate data; it is removed when the driver ends."""
    made = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, made)
    return made


def _removed(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session is gone: nothing can be removed through it
        pass


def existing(spark: SparkSession, path: str) -> bool:
    """Whether a path is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder all executors share."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)
