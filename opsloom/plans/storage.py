"""Where intermediate data goes: the cluster's shared folder, never a machine-local one."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: The temporary folder of each local application, made once.
_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Only a local master without the setting gets a temporary folder; on a
    cluster a missing setting is an error, because executors would not see it.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        application = spark.sparkContext.applicationId
        if application not in _local:
            _local[application] = tempfile.mkdtemp(prefix="opsloom-")
        return _local[application]
    raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder of this application below the shared root, for written tables and stream progress."""
    application = spark.sparkContext.applicationId
    return f"{shared_root(spark).rstrip('/')}/opsloom/{application}/{label}-{uuid.uuid4().hex}"


def drop_written(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; frames built on it end with that."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark).rstrip('/')}/opsloom/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    The plan restarts from files, so a lost executor replays one step and not a
    whole loop; the rows are computed once, and their size is known to the planner.
    """
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
