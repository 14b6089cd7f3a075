"""Compute a shared intermediate result once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints, or one set on the context."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def work_folder(spark: SparkSession) -> str:
    """The shared folder, or for a local session without one a temporary folder.

    A temporary folder goes when the Python process ends. Any other master has to name
    a folder that all its machines share.
    """
    folder = shared_folder(spark)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="laureate-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def _through(df: DataFrame, folder: str, label: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/{label}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_once(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back.

    Later steps then read only the columns they need, and a lost executor costs
    a re-read instead of the whole lineage. Without a shared folder the plan is
    returned as it is and Spark reuses what shuffles it can. The files stay
    until removed from the folder.
    """
    folder = shared_folder(df.sparkSession)
    return _through(df, folder, label) if folder else df


def written(df: DataFrame, label: str) -> DataFrame:
    """As ``written_once``, but always written, for results that a second run would change."""
    return _through(df, work_folder(df.sparkSession), label)
