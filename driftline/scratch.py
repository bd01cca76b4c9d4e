"""Results that later steps read more than once, written to the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table under ``spark.checkpoint.dir``: it has no lineage, and lost executors lose nothing of it.

    The tables go when the application ends.  Only a session within one process and without that
    setting gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: lineage is cut in a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
        root = context.getCheckpointDir()
    home = f"{root}/driftline-{context.applicationId}-kept"
    path = context._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    at = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
