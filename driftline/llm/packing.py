"""Best-fit packing planned over a histogram of lengths.

Documents are encoded once, cut where they are longer than a sequence, and numbered within
(task, length).  The planner sees only how many pieces have each length, at most ``capacity``
numbers, and lays runs of equal pieces into runs of equal sequences, tightest first.  Pieces
then take their slots by their rank within their length.

Nothing here grows on the driver with the documents: the histogram has at most ``capacity``
rows, and the plan at most 4 * capacity * log2(capacity) runs, because a run's free room is
more than halved each time it is filled from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import batches_out, cut, table
from .word_bpe import WordBpe

CAPACITY = 4096
END_ID = 1


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: key, piece, start, length, ids, and its task and rank there among equal lengths.

    A null text counts as empty and makes one piece, the end id.  Rows are taken as they come:
    repeated rows or null keys each make their own pieces.  ``ids`` holds little-endian unsigned
    32-bit integers.  Materialise the result before placing it; a task's ranks are its own.
    """
    out = T.StructType(
        [
            docs.schema[key],
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("task", T.LongType()),
            T.StructField("rank", T.LongType()),
        ]
    )
    where = path or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        coder, task, seen = WordBpe(where), TaskContext.get().partitionId(), [0] * (capacity + 1)
        step = 4 * capacity

        for batch in batches:
            for part in W.chunks(batch):
                for k, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1)), strict=True):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), step)):
                        cut_ids = ids[at : at + step]
                        length = len(cut_ids) // 4
                        yield k, n, at // 4, length, cut_ids, task, seen[length]
                        seen[length] += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), out, lambda r: len(r[4]))

    return docs.select(key, text).mapInArrow(run, out)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, pieces, first sequence, pieces a sequence, offset).

    Longest first; each run of equal pieces goes to the sequences with the least room that
    still fits, as many a sequence as fit, which is where best fit would put them one by one.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    opened = 0
    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
        left, rank = counts[length], 0
        rooms = [room for room in free if room >= length]
        heapify(rooms)
        while left:
            if rooms:
                room = rooms[0]
                first, many = free[room].pop()
                if not free[room]:
                    del free[room]
                    heappop(rooms)
                fresh = False
            else:
                room, first, fresh = capacity, opened, True
                many = -(-left // (capacity // length))
            each = room // length
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            if full:
                runs.append((length, rank, full * each, first, each, capacity - room))
                free.setdefault(room - each * length, []).append((first, full))
                rank += full * each
                left -= full * each
            if rest:
                runs.append((length, rank, rest, first + full, rest, capacity - room))
                free.setdefault(room - rest * length, []).append((first + full, 1))
                if room - rest * length >= length:
                    heappush(rooms, room - rest * length)
                rank += rest
                left -= rest
            used = full + bool(rest)
            if fresh:
                opened += used
            elif used < many:
                if room not in free:
                    heappush(rooms, room)
                free.setdefault(room, []).append((first + used, many - used))
    if len(runs) > 4 * capacity * math.ceil(math.log2(max(capacity, 2))):
        raise AssertionError("the plan is larger than its bound")
    return runs


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its sequence_id and offset.  ``cut_pieces`` must be a materialised table (see ``pieces``)."""
    spark = cut_pieces.sparkSession
    counts = cut(cut_pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(plan(histogram, capacity) or np.zeros((0, 6)), np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    planned = spark.sparkContext.broadcast(runs)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    # one row for each task and length, as many as tasks make: never broadcast
    ranked = cut_pieces.join(base.hint("merge"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("_base")).drop("_base", "task")
    out = T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = ranked.columns

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        runs, arrow = planned.value, to_arrow_schema(out)
        starts = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False).astype(np.int64)
            run = runs[np.searchsorted(starts, (length << 48) + rank, "right") - 1]
            at = rank - run[:, 1]
            sequence, offset = run[:, 3] + at // run[:, 4], run[:, 5] + at % run[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), pa.array(sequence), pa.array(offset)], schema=arrow)  # noqa: B905

    return ranked.mapInArrow(take, out).drop("rank")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length and ids, from placed pieces that carry ids.

    A sequence has at most ``capacity`` ids, so a group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", joined.alias("ids"))


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and place whole documents, ids included."""
    return place(cut(pieces(docs, text, key, path, capacity=capacity), "pieces"), capacity)


def digest(docs: DataFrame) -> DataFrame:
    """Placed pieces with the CRC of their ids instead of the ids, which then never reach a disk."""
    rows = pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(cut(rows, "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place; ``pieces`` states null texts, repeats and null keys, an empty table packs into nothing."""
    return digest(table(spark, sf_dir, "documents"))
