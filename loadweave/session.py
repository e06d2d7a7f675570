"""What the library needs from a session: shared scratch space and staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where none is named, the checkpoint folder of the context serves. A bare
    local session gets a private one; on a cluster that is an error, as other
    machines would not see the folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"name a shared folder in spark.checkpoint.dir; {master} cannot use one of this machine")
        root = tempfile.mkdtemp(prefix="loadweave-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path no other run uses, below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a table once and go on from the stored copy.

    Plans that read their input several times (numbering, carries) start from
    a stored table, so the work before it is neither repeated nor lost with an
    executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
