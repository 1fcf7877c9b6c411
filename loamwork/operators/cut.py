"""Tables that several parts of a plan read, computed once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder that the cluster names in spark.checkpoint.dir: its lineage ends there, lost
    executors or not, and Spark deletes it once nothing refers to it. A folder of its own only where none is named and all
    tasks run in the driver's process."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="loamwork-"))
    return df.checkpoint()
