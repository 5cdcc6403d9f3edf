"""Shared folders and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made by this process, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    The folder is the one named by ``spark.checkpoint.dir``; only where that
    setting is missing and the session runs on one machine one is made under /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share: {master} has no common /tmp")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{base.rstrip('/')}/geoloom-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage so that later actions do not recompute ``df``, and survives
    the loss of any executor because the folder is shared storage.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the folders that this process made; call it when no result that reads them is needed any more."""
    conf, n = spark._jsc.hadoopConfiguration(), 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
