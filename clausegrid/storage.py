"""Results that several later steps read are stored once in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from clausegrid.sources.sinks import delete_at_exit


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one is made only where the session names none and runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        there = spark.conf.get("spark.checkpoint.dir", None)
        if there is None:
            if sc.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            there = tempfile.mkdtemp(prefix="clausegrid-")
        sc.setCheckpointDir(there)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one; it goes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path
