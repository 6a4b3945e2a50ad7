"""Lineage cuts between rounds, in the folder that the session names, and joins of tables that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one set on the context; a folder of our own only where neither is set."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    return root or "file:///tmp/checkpoints/arealis"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep its rows in the shared folder: later rounds and lost executors read them from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffle and sort whatever its size is thought to be.

    The planner's sizes of stored, exploded and grouped rows come from compressed files and are far too small, so it would send
    tables that grow with the input through the driver to every task.
    """
    return df.hint("merge")
