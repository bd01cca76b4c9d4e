"""Daily report files as they land: zip archives of one CSV file each.

Fetching them is left to other tools; a day that isn't there, an archive or member that can't be read,
any other number of members and rows of another width are rows of ``problems``, not exceptions.
"""

from __future__ import annotations

import datetime
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.schema import RAW

from .ais import named

#: Bytes of CSV text parsed at once.
BLOCK = 8 << 20
NAMES = [f.name for f in RAW.fields]

_OUT = T.StructType([*(T.StructField(n, T.StringType()) for n in NAMES), T.StructField("file_name", T.StringType()), T.StructField("row", T.LongType())])
_PROBLEM = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("error", T.StringType())])


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, content): an archive is read by one task, which holds it compressed (Spark reads files up to 2 GB so)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def _member(raw: bytes) -> tuple[zipfile.ZipFile, str]:
    """The archive and its one member, read through once; raises ``ValueError`` for any other."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        raise ValueError("not a zip archive") from None
    if len(archive.namelist()) != 1:
        raise ValueError(f"one member expected, {len(archive.namelist())} found")
    try:
        broken = archive.testzip()
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError) as why:
        raise ValueError(f"its member can't be read: {why}") from None
    if broken is not None:
        raise ValueError("its member can't be read: the checksum differs")
    return archive, archive.namelist()[0]


def _text(column: pa.Array) -> pa.Array:
    """Bytes as text; what isn't UTF-8 is replaced by its mark."""
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in column.to_pylist()], pa.string())


def _parts(raw: bytes, wrong: list[str]) -> Iterator[list[pa.Array]]:
    """The columns of an archive's rows, some at a time; what can't be used of it is said in ``wrong``.

    A row of another width than the header's is left out.  Where a row can't be parsed at all, the rows
    before it are kept.
    """
    try:
        archive, member = _member(raw)
    except ValueError as why:
        wrong.append(str(why))
        return
    ragged = 0

    def skip(row: pa.csv.InvalidRow) -> str:
        nonlocal ragged
        ragged += 1
        return "skip"

    # one thread: the handler counts
    convert = pa.csv.ConvertOptions(column_types=dict.fromkeys(NAMES, pa.binary()), include_columns=NAMES, include_missing_columns=True, strings_can_be_null=True, null_values=[""])
    read, parse = pa.csv.ReadOptions(block_size=BLOCK, use_threads=False), pa.csv.ParseOptions(invalid_row_handler=skip)
    n = 0
    with archive.open(member) as lines:
        try:
            for part in pa.csv.open_csv(lines, read, parse, convert):
                n += part.num_rows
                yield [_text(c) for c in part.columns]
        except pa.ArrowInvalid as why:
            wrong.append(f"unreadable behind row {n}: {why}" if n else f"no rows: {why}")
    if ragged:
        wrong.append(f"{ragged} rows of another width")


def read_zipped(spark: SparkSession, path: str) -> DataFrame:
    """Reports of all archives, as ``ais.read_csv`` gives them; what can't be used of them is left to ``problems``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                for columns in _parts(raw, []):
                    n = len(columns[0])
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * n, pa.string()), pa.array(range(at, at + n), pa.int64())], names=_OUT.names)
                    at += n

    rows = _archives(spark, path).mapInArrow(run, _OUT)
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in RAW.fields]
    return named(rows.select(*typed, "file_name", F.col("row").alias("seq")))


def problems(spark: SparkSession, path: str, first: datetime.date | None = None, last: datetime.date | None = None) -> DataFrame:
    """(file_name, error): what can't be used of archives, and, with bounds, the days between them (inclusive) without a file.

    Every archive is read through as ``read_zipped`` reads it, so what is not named here is sound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wrong: list[str] = []
                for _ in _parts(raw, wrong):
                    pass
                bad += [(name, why) for why in wrong]
            if bad:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in bad]), pa.array([e for _, e in bad])], names=_PROBLEM.names)

    archives = _archives(spark, path)
    found = archives.mapInArrow(run, _PROBLEM)
    if first is None or last is None:
        return found
    there = archives.select("file_name")
    days = days_between(spark, first, last).select(F.concat(F.lit("aisdk-"), F.date_format("day", "yyyy-MM-dd"), F.lit(".zip")).alias("file_name"))
    return found.unionByName(days.join(there, "file_name", "left_anti").withColumn("error", F.lit("not found")))


def days_between(spark: SparkSession, first: datetime.date, last: datetime.date) -> DataFrame:
    """(day): both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("day")) if first <= last else spark.createDataFrame([], "day date")

