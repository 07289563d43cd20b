"""The shared folder for checkpoints, streaming state and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Folders made for local sessions that name none, by application.
_MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a temporary one only for a local session that names none.

    A local session has one machine, so any folder is shared there; on a cluster a missing name is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _MADE:
        _MADE[application] = tempfile.mkdtemp(prefix="molweave-")
    return _MADE[application]


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/molweave/{kind}-{uuid.uuid4().hex}"


def remove_stored(spark: SparkSession) -> bool:
    """Delete all that this package wrote to the shared folder; for callers whose plans no longer read it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/molweave")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Used where a plan needs the same rows twice and recomputing them would cost a shuffle or could place rows
    differently. The files survive the loss of executors, which cached blocks do not.
    """
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
