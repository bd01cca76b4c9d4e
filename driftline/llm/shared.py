"""Scratch tables in the cluster's shared folder, and small helpers that all corpus operators use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of output gathered before a batch is sent back to the JVM, and its bytes of text.
OUT_ROWS = 2000
OUT_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Only a session within one process and without it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: lineage is cut in a folder that all executors share")
        root = tempfile.mkdtemp(prefix="driftline-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root


#: Folder within the application's scratch folder that tables are written to just now.
_SCOPE: ContextVar[str] = ContextVar("scope", default="")


def _home(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/driftline-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, where: str) -> tuple[JavaObject, JavaObject]:
    """A path of Hadoop's and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str, gather: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lost executors lose nothing of it.

    The application's scratch folder is removed when the application ends.  With ``gather``, many
    tasks' small results are first brought together into files of the size that adaptive execution
    aims at: on a local or mounted folder Hadoop starts three processes (chmod) for each file, and
    until such a process has its own program, its memory is counted as another whole executor.
    """
    spark = df.sparkSession
    home = _home(spark)
    path, files = _path(spark, home)
    files.deleteOnExit(path)
    at = f"{home}/{_SCOPE.get()}{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if gather else df).write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns, as ``cut`` writes it; the scratch tables that it was made from are removed."""
    outer = _SCOPE.get()
    inner = f"{outer}{name}-{uuid.uuid4().hex}-parts/"
    entered = _SCOPE.set(inner)
    try:
        made = build()
    finally:
        _SCOPE.reset(entered)
    out = cut(made, name)
    path, files = _path(spark, f"{_home(spark)}/{inner}")
    files.delete(path, True)
    return out


def batches_out(rows: Iterable[tuple], schema: T.StructType, weight: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Gather row tuples into Arrow batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    kept: list[tuple] = []
    size = 0
    for row in rows:
        kept.append(row)
        size += weight(row) if weight else 0
        if len(kept) >= OUT_ROWS or size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), arrow, strict=True)], schema=arrow)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), arrow, strict=True)], schema=arrow)
