"""Published embeddings: ``.npz`` archives with the arrays ``embeddings``, ``mmsis`` and ``start_times``, read and written.

Archives are read from any store that Spark reads, one by a task.  They are written by a Python data source to any
store that Arrow writes: tasks write beside the target, and the commit moves the files of the
attempts that counted, so a task that ran twice leaves one file.
"""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Rows of a batch that leaves a task.
ROWS = 4096
#: Rows of an archive; a task writes as many archives as it needs.
MOST_ROWS = 1 << 18

_OUT = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("mmsi", T.LongType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


def _arrays(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An archive's three arrays; raises ``ValueError`` for any other content.  Pickled objects are never loaded."""
    try:
        with np.load(io.BytesIO(raw), allow_pickle=False) as found:
            if missing := [n for n in ("embeddings", "mmsis", "start_times") if n not in found]:
                raise ValueError(f"arrays are missing: {', '.join(missing)}")
            x, mmsi, start = found["embeddings"], found["mmsis"], found["start_times"]
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, KeyError, TypeError) as why:
        raise ValueError(f"not an archive of arrays: {why}") from None
    if x.ndim != 2 or mmsi.shape != (len(x),) or start.shape != (len(x),):
        raise ValueError(f"shapes don't fit: {x.shape}, {mmsi.shape}, {start.shape}")
    return x.astype(np.float32), mmsi.astype(np.int64), start.astype(np.int64)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, row, embedding, mmsi, start_time, error): a row for each vector of each archive under a folder, or of one.

    An archive that can't be used is one row with its name and ``error``.  The schema is fixed, so no archive
    is opened before a task reads it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(_OUT)
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    x, mmsi, start = _arrays(raw)
                except ValueError as why:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((name, None, None, None, None, str(why)), schema, strict=True)], schema=schema)
                    continue
                for at in range(0, len(x), ROWS):
                    part = x[at : at + ROWS]
                    n = len(part)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), lists, pa.array(mmsi[at : at + n]), pa.array(start[at : at + n]), pa.nulls(n, pa.string())], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content").mapInArrow(run, _OUT)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite, self.staging = target.rstrip("/"), overwrite, f"{target.rstrip('/')}/.staging-{uuid.uuid4().hex}"

    def _store(self, where: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(where) if ":" in where.partition("/")[0] else (fs.LocalFileSystem(), where)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, at = self._store(self.staging)
        store.create_dir(at)
        task, kept, rows, files = TaskContext.get(), [], 0, []

        def flush() -> None:
            nonlocal kept, rows
            table = pa.Table.from_batches(kept).combine_chunks()
            x = table.column("embedding").combine_chunks()
            wide = {len(v) if v is not None else -1 for v in x.to_pylist()} if x.null_count else set(np.diff(x.offsets.to_numpy()).tolist())
            if len(wide) != 1 or -1 in wide:
                raise ValueError(f"an archive holds vectors of one length, and no nulls: {sorted(wide)}")
            out = io.BytesIO()
            np.savez_compressed(out, embeddings=x.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(x), -1), mmsis=table.column("mmsi").to_numpy(), start_times=table.column("start_time").to_numpy())
            name = f"part-{task.partitionId():05}-{len(files):03}-{task.taskAttemptId()}.npz"
            with store.open_output_stream(f"{at}/{name}") as stream:
                stream.write(out.getvalue())
            files.append(name)
            kept, rows = [], 0

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                rows += batch.num_rows
            if rows >= MOST_ROWS:
                flush()
        if rows:
            flush()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, at = self._store(self.staging)
        _, target = self._store(self.target)
        store.create_dir(target)
        old = [f.path for f in store.get_file_info(fs.FileSelector(target)) if f.path.endswith(".npz")] if self.overwrite else []
        for name in (n for m in messages if m is not None for n in m.files):
            store.move(f"{at}/{name}", f"{target}/{name}")
        for path in old:
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        store, at = self._store(self.staging)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class NpzSink(DataSource):
    """``format("npz_vectors")`` for frames of embedding, mmsi and start_time."""

    @classmethod
    def name(cls) -> str:
        return "npz_vectors"

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        if missing := [c for c in ("embedding", "mmsi", "start_time") if c not in schema.names]:
            raise ValueError(f"columns are missing: {', '.join(missing)}")
        return _Writer(self.options["path"], overwrite)


def write_npz(vectors: DataFrame, path: str, mode: str = "append") -> None:
    """Archives under a folder, which all executors share; ``mode`` is append or overwrite."""
    vectors.sparkSession.dataSource.register(NpzSink)
    vectors.select("embedding", F.col("mmsi").cast("long"), F.col("start_time").cast("long")).write.format("npz_vectors").mode(mode).save(path)
