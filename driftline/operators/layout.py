"""Vectors laid out in the plane so that neighbours stay neighbours.

The graph of nearest neighbours gives each vector edges whose weights fall with distance, on the
vector's own scale; an edge that both ends hold is the stronger for it.  Principal components give the
first places.  Then, in rounds, the plane is cut into blocks of bounded size, along one axis and
the other by turns, and every block is moved by itself for some steps: ends of edges draw each other
near, and points of a bounded sample of all places push away.  Ends in other blocks stand
still for that round; they move with their own block, along the edges that they hold.

A task holds a block: its points, and the edges that these hold, at most the graph's number each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.hashing import first_by_hash
from driftline.scratch import kept

from .frames import reduced
from .neighbours import K, graph, in_blocks, usable

#: Points of a block.
BLOCK = 4096
ROUNDS, STEPS = 8, 40
#: Places of the sample that pushes, and how many of them a point meets in a step.
SAMPLE, MET = 1024, 24
#: How strongly others push for each unit of an edge's weight.
PUSH = 5.0
#: The curve 1 / (1 + A d^2B) of nearness in the plane, fitted to points that lie closely up to 0.1 apart.
A, B = 1.577, 0.895
#: Spread of the first places.
EXTENT = 10.0

_WEIGHT = T.StructType([T.StructField("id", T.LongType()), T.StructField("to", T.LongType()), T.StructField("w", T.DoubleType())])
_POINT = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_PLACED = T.StructType([*_POINT.fields, T.StructField("block", T.LongType())])


def scale(d: np.ndarray) -> tuple[float, float]:
    """The distance of the nearest neighbour and the scale at which the weights of sorted distances sum to log2 of their number."""
    near = float(d[d > 0][0]) if (d > 0).any() else 0.0
    over = np.maximum(d - near, 0)
    want, low, high = math.log2(max(len(d), 2)), 0.0, max(float(over.max(initial=0.0)), 1e-12) * 1e3
    for _ in range(60):
        mid = (low + high) / 2
        if np.exp(-over / mid).sum() > want:
            high = mid
        else:
            low = mid
    return near, max(high, 1e-9)


def weights(edges: DataFrame) -> DataFrame:
    """(id, to, w) of the edges (id, to, dist): w = a + b - ab of the weights a and b that both ends give, 0 for none."""
    held = edges.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dist", "to"))).alias("e")).select("id", F.col("e.to").alias("to"), F.col("e.dist").alias("dist"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tos, ws = [], [], []
            for row, key in enumerate(batch.column(0).to_numpy().tolist()):
                d = batch.column(2)[row].values.to_numpy()
                near, sigma = scale(d)
                ids.append(np.full(len(d), key))
                tos.append(batch.column(1)[row].values.to_numpy())
                ws.append(np.exp(-np.maximum(d - near, 0) / sigma))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in ((ids, pa.int64()), (tos, pa.int64()), (ws, pa.float64()))], names=_WEIGHT.names)

    own = kept(held.mapInArrow(run, _WEIGHT))
    back = own.select(F.col("to").alias("id"), F.col("id").alias("to"), F.col("w").alias("_b"))
    b = F.coalesce("_b", F.lit(0.0))
    return own.join(back, ["id", "to"], "left").select("id", "to", (F.col("w") + b - F.col("w") * b).alias("w"))


def moved(at: np.ndarray, head: np.ndarray, tail: np.ndarray, w: np.ndarray, fixed: np.ndarray, sample: np.ndarray, rates: np.ndarray, seed: int) -> np.ndarray:
    """Places of a block's points after a step for each rate.

    An edge leads from point ``head`` to point ``tail`` of the block, or, where that is -1, to its place in ``fixed``.
    """
    at, draw = at.copy(), np.random.RandomState(seed)
    inside = tail >= 0
    degree = np.bincount(head, w, len(at)) + np.bincount(tail[inside], w[inside], len(at))
    for rate in rates:
        other = np.where(inside[:, None], at[tail], fixed)
        gap = at[head] - other
        d2 = np.maximum((gap**2).sum(1), 1e-12)
        pull = np.clip((-2 * A * B * d2 ** (B - 1) / (1 + A * d2**B))[:, None] * gap, -4, 4) * w[:, None]
        force = np.stack([np.bincount(head, pull[:, i], len(at)) - np.bincount(tail[inside], pull[inside, i], len(at)) for i in (0, 1)], 1)
        # what both ends of edges do is averaged, so a point with many edges takes no longer steps
        force /= np.maximum(degree, 1e-9)[:, None]
        if len(sample):
            gap = at[:, None] - sample[draw.randint(0, len(sample), (len(at), min(MET, len(sample))))]
            d2 = (gap**2).sum(2)
            push = np.clip((2 * B / ((1e-3 + d2) * (1 + A * d2**B)))[:, :, None] * gap, -4, 4)
            force += np.where(degree > 0, PUSH, 0)[:, None] * push.mean(1)
        at += rate * force
    return at


def _blocks(points: DataFrame, axis: str) -> DataFrame:
    """The points with a block each, of neighbours along an axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches, BLOCK):
            # a block is known by the first of its points
            first = block.column("id")[0].as_py()
            yield from block.append_column("block", pa.array(np.full(block.num_rows, first), pa.int64())).combine_chunks().to_batches()

    return points.repartitionByRange(axis, "id").sortWithinPartitions(axis, "id").mapInArrow(run, _PLACED)


def _round(points: DataFrame, edges: DataFrame, number: int, rounds: int, steps: int, seed: int) -> DataFrame:
    placed = kept(_blocks(points, "xy"[number % 2]))
    sample = np.array([[r["x"], r["y"]] for r in first_by_hash(placed, SAMPLE, "id", seed=seed + number).orderBy("_order").collect()]).reshape(-1, 2)
    ends = placed.select(F.col("id").alias("to"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    led = edges.join(ends, "to").groupBy("id").agg(F.collect_list(F.struct("to", "w", "to_x", "to_y")).alias("e"))
    rows = placed.join(led, "id", "left").select("block", "id", "x", "y", *[F.coalesce(F.col(f"e.{n}"), F.array().cast(t)).alias(n) for n, t in (("to", "array<bigint>"), ("w", "array<double>"), ("to_x", "array<double>"), ("to_y", "array<double>"))])
    total = rounds * steps
    rates = 1 - (number * steps + np.arange(steps)) / total

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("id").combine_chunks()
        column = {n: block.column(n).combine_chunks() for n in block.column_names}
        ids = column["id"].to_numpy()
        at = np.stack([column["x"].to_numpy(), column["y"].to_numpy()], 1)
        head = np.repeat(np.arange(len(ids)), np.diff(column["to"].offsets.to_numpy()))
        to, w, x, y = (column[n].flatten().to_numpy() for n in ("to", "w", "to_x", "to_y"))
        order = np.lexsort((to, head))  # sums are alike in every run
        head, to, w, fixed = head[order], to[order], w[order], np.stack([x, y], 1)[order]
        tail = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        tail = np.where(ids[tail] == to, tail, -1)
        out = moved(at, head, tail, w, fixed, sample, rates, (seed * 1009 + int(ids[0])) % (1 << 32))
        return pa.table([pa.array(ids), pa.array(out[:, 0]), pa.array(out[:, 1])], names=_POINT.names)

    return kept(rows.groupBy("block").applyInArrow(run, _POINT))


def layout(vectors: DataFrame, edges: DataFrame | None = None, vector: str = "embedding", key: str = "vec_id", k: int = K, rounds: int = ROUNDS, steps: int = STEPS, seed: int = 7) -> DataFrame:
    """(key, x, y): a place in the plane for every row with a key (a unique long) and a vector.

    ``edges`` (id, to, dist) are found if they aren't given.  Points without an edge keep their
    first place; an empty table gives no rows.
    """
    nodes = kept(usable(vectors, vector, key))
    if nodes.isEmpty():
        return nodes.sparkSession.createDataFrame([], f"{key} long, x double, y double")
    edges = kept(weights(graph(nodes, k, "v", "id", seed) if edges is None else edges))
    flat = kept(reduced(nodes, "v").select("id", F.col("point")[0].alias("x"), F.col("point")[1].alias("y")))
    extent = flat.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    # equal vectors begin a little apart, by a hash
    apart = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1e6 for i in (0, 1)]
    points = flat.select("id", *[(F.col(n) / extent * EXTENT + a).alias(n) for n, a in zip("xy", apart, strict=True)])
    for number in range(rounds):
        points = _round(points, edges, number, rounds, steps, seed)
    return points.withColumnRenamed("id", key)
