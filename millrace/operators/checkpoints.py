"""Cutting lineage in loops: tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(df: DataFrame) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of this machine, for sessions on this machine only."""
    sc = df.sparkSession.sparkContext
    found = sc.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and reads it back; the table is deleted when the session's process ends."""
    sc = df.sparkSession.sparkContext
    path = os.path.join(shared_dir(df), f"step-{uuid.uuid4().hex}")
    df.write.parquet(path)
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)
