"""Exact searches among very many vectors, by cells around pivots.

A bounded number of vectors are pivots; every vector belongs to the cell of its nearest one, and a
cell's facts (its smallest and largest distance to the pivot, its largest weight) fit every task.
By the triangle inequality a query at distance d from a pivot is at least d - far and near - d away
from every member of its cell.  A query first meets its own cell, and then the other
cells that can hold something as good as what it has found.  Within a cell only members are measured whose own
distance to the pivot allows it.  All of it is exact; pivots decide only how much is measured, which is counted.

Queries and members of a cell meet in blocks of bounded size, each pair of blocks in one group, so a
cell may hold any share of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.hashing import first_by_hash
from driftline.scratch import kept

from .clustering import matrix, squares

#: Pivots; they and a cell's facts are sent to every task.
PIVOTS = 256
#: Rows of a block of queries or of members.
BLOCK = 4096
#: Share and length by which bounds give way to rounding.
SLACK, LEAST = 1e-9, 1e-12

_ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("g", T.LongType()), T.StructField("w", T.DoubleType())])
_CELLED = T.StructType([*_ROW.fields, T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])
_FOUND = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("tie", T.LongType()), T.StructField("to", T.LongType()), T.StructField("to_g", T.LongType()), T.StructField("measured", T.LongType())])


@dataclass(frozen=True)
class Rule:
    """What is searched: the member with the least distance over the sum of both weights.

    ``apart`` leaves out members of the query's own group, ``other`` the query itself and members at
    distance 0.  Ties go to the smallest group with ``by_group``, then to the smallest id.
    """

    apart: bool = False
    other: bool = False
    by_group: bool = False


def pivots(vectors: DataFrame, n: int = PIVOTS, vector: str = "embedding", key: str = "vec_id", seed: int = 7) -> np.ndarray:
    """At most ``n`` vectors, chosen by hash."""
    chosen = first_by_hash(vectors.select(key, vector), n, key, seed=seed).collect()
    return np.array([r[vector] for r in sorted(chosen, key=lambda r: r["_order"])], float) if chosen else np.zeros((0, 0))


def celled(rows: DataFrame, points: np.ndarray) -> DataFrame:
    """Rows (id, v, g, w) with the nearest pivot and the distance to it."""
    sent = rows.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                d = squares(matrix(batch.column(1)), sent.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt(d[np.arange(len(d)), cell]))], names=_CELLED.names)

    return rows.select("id", F.col("v").cast("array<double>"), F.col("g").cast("long"), F.col("w").cast("double")).mapInArrow(run, _CELLED)


def _facts(members: DataFrame, n: int) -> dict[str, np.ndarray]:
    """By cell: size, and the extremes of r, weight and group; a row for each pivot."""
    out = {"n": np.zeros(n, np.int64), "near": np.full(n, np.inf), "far": np.full(n, -np.inf), "w": np.zeros(n), "low": np.zeros(n, np.int64), "high": np.full(n, -1)}
    for r in members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("near"), F.max("r").alias("far"), F.max("w").alias("w"), F.min("g").alias("low"), F.max("g").alias("high")).collect():
        for name in out:
            out[name][r["cell"]] = 0 if r[name] is None else r[name]
    return out


def _block(of: str, sizes: np.ndarray) -> F.Column:
    """A block within a cell of so many rows, by hash."""
    blocks = F.array(*[F.lit(int(max(1, -(-s // BLOCK)))) for s in sizes.tolist()])
    return F.pmod(F.xxhash64("id"), F.get(blocks, F.col(of))).cast("int")


def _best(q: dict, m: dict, rule: Rule) -> tuple[list, int]:
    """(value, tie, to, group) for each query of a block, and how many distances were measured.

    A query's bound, where it has one, and its distance to the pivot say which members can matter.
    """
    order = np.argsort(m["r"], kind="stable")
    m = {k: v[order] for k, v in m.items()}
    top = float(m["w"].max(initial=0.0))
    out, measured = [None] * len(q["id"]), 0
    reach = q["bound"] * (q["w"] + top)
    reach = np.where(np.isfinite(reach), reach * (1 + SLACK) + LEAST, np.inf)
    low, high = np.searchsorted(m["r"], q["d"] - reach, "left"), np.searchsorted(m["r"], q["d"] + reach, "right")
    by_place = np.argsort(low, kind="stable")
    for at in range(0, len(by_place), 32):
        rows = by_place[at : at + 32]
        a, b = int(low[rows].min()), int(high[rows].max())
        if a >= b:
            continue
        part = {k: v[a:b] for k, v in m.items()}
        d = np.sqrt(squares(q["v"][rows], part["v"]))
        measured += d.size
        scale = q["w"][rows, None] + part["w"]
        value = np.divide(d, scale, out=np.full(d.shape, np.inf), where=scale > 0)
        if rule.apart:
            value[part["g"] == q["g"][rows, None]] = np.inf
        if rule.other:
            value[(part["id"] == q["id"][rows, None]) | (d == 0)] = np.inf
        least = value.min(1)
        for i, row in enumerate(rows.tolist()):
            if np.isfinite(least[i]):
                same = np.flatnonzero(value[i] == least[i])
                tie, to, g = min(((int(part["g"][j]) if rule.by_group else 0), int(part["id"][j]), int(part["g"][j])) for j in same.tolist())
                out[row] = (float(least[i]), tie, to, g)
    return out, measured


def _columns(table: pa.Table, names: tuple[str, ...]) -> dict:
    table = table.combine_chunks()
    return {n: (np.asarray(table.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(table.num_rows, -1) if n == "v" else table.column(n).to_numpy()) for n in names}


def _meet(queries: DataFrame, members: DataFrame, n_members: np.ndarray, n_queries: np.ndarray, rule: Rule) -> DataFrame:
    """The best member of each query in each cell (``at``) that it is sent to, of those within its bound."""
    spread = F.array(*[F.lit(int(max(1, -(-s // BLOCK)))) for s in n_members.tolist()])
    q_spread = F.array(*[F.lit(int(max(1, -(-s // BLOCK)))) for s in n_queries.tolist()])
    left = queries.withColumns({"q": _block("at", n_queries), "m": F.explode(F.sequence(F.lit(0), F.get(spread, F.col("at")) - 1))}).select("at", "q", "m", "id", "v", "g", "w", "d", "bound")
    right = members.withColumnRenamed("cell", "at").withColumns({"m": _block("at", n_members), "q": F.explode(F.sequence(F.lit(0), F.get(q_spread, F.col("at")) - 1))}).select("at", "q", "m", "id", "v", "g", "w", "r")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(_FOUND.fields, (pa.int64(), pa.float64(), *[pa.int64()] * 4), strict=True)})
        q, m = _columns(x, ("id", "v", "g", "w", "d", "bound")), _columns(y, ("id", "v", "g", "w", "r"))
        best, measured = _best(q, m, rule)
        at = [i for i, b in enumerate(best) if b is not None]
        rows = [(int(q["id"][i]), *best[i], 0) for i in at] + [(int(q["id"][0]), float("inf"), None, None, None, measured)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), *[pa.int64()] * 4), strict=True)], names=_FOUND.names)

    return left.groupBy("at", "q", "m").cogroup(right.groupBy("at", "q", "m")).applyInArrow(run, _FOUND)


def _chosen(found: DataFrame) -> DataFrame:
    """Each query's best, by value, tie and id, and the distances measured for it (those of a block count for one of its queries)."""
    best = F.min(F.when(F.col("to").isNotNull(), F.struct("value", "tie", "to", "to_g"))).alias("b")
    return found.groupBy("id").agg(best, F.sum("measured").alias("measured")).select("id", "b.value", "b.tie", "b.to", "b.to_g", "measured")


def search(queries: DataFrame, members: DataFrame, rule: Rule, points: np.ndarray, shared: bool = False) -> DataFrame:
    """id, value, to, to_g and measured for each row of ``queries``: its best row of ``members`` by the rule, nulls where there is none.

    Both have id (long, unique), v (numbers), g (group, long) and w (weight).  With ``shared`` only
    the best of each group of queries counts: a query that can't be as good as what another one of
    its group has found is left with what it has.
    """
    if not len(points):
        return queries.select("id", F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("to"), F.lit(None).cast("long").alias("to_g"), F.lit(0).cast("long").alias("measured"))
    # each step in Python ends in a table: chained, each would hold a process of its own beside every running task
    members, queries = kept(celled(members, points)), kept(celled(queries, points))
    facts = _facts(members, len(points))
    own = _facts(queries, len(points))["n"]
    first = kept(_meet(queries.withColumns({"at": F.col("cell"), "d": F.col("r"), "bound": F.lit(float("inf"))}), members, facts["n"], own, rule))
    begun = _chosen(first)
    sent = queries.sparkSession.sparkContext.broadcast((points, facts))
    bounded = T.StructType([*_CELLED.fields, T.StructField("bound", T.DoubleType())])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The query with what some member reaches at least: one of a cell is no further than the pivot and the cell's extent."""
        where, f = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                d = np.sqrt(squares(matrix(batch.column(1)), where))
                g, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                some = np.broadcast_to(f["n"] > 0, d.shape)
                if rule.apart:
                    some = some & ((f["low"] != f["high"]) | (f["low"] != g[:, None]))
                if rule.other:
                    # its only member may be the query itself, or lie where the query does
                    some = np.zeros(d.shape, bool)
                reach = np.where(some, d + f["far"], np.inf).min(1) * (1 + SLACK) + LEAST
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.divide(reach, w, out=np.full(len(w), np.inf), where=w > 0))], names=bounded.names)

    known = kept(queries.mapInArrow(within, bounded).join(begun.select("id", "value"), "id", "left").withColumn("bound", F.least("bound", "value")).drop("value"))
    if shared:
        best = known.groupBy("g").agg(F.min("bound").alias("least"))
        known = known.join(best, "g").withColumn("bound", F.least("bound", "least")).drop("least")
    out = T.StructType([*_ROW.fields, T.StructField("bound", T.DoubleType()), T.StructField("at", T.IntegerType()), T.StructField("d", T.DoubleType())])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The query once for each other cell that may hold something as good."""
        where, f = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                d = np.sqrt(squares(matrix(batch.column(1)), where))
                g, w, cell, bound = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5))
                least = np.maximum(np.maximum(d - f["far"], f["near"] - d), 0) * (1 - SLACK) - LEAST
                may = (f["n"] > 0) & (least <= bound[:, None] * (w[:, None] + f["w"]))
                may[np.arange(len(cell)), cell] = False
                if rule.apart:
                    may &= ~((f["low"] == f["high"]) & (f["low"] == g[:, None]))
                to, of = np.nonzero(may)
                for begin in range(0, len(to), BLOCK):
                    i, j = to[begin : begin + BLOCK], of[begin : begin + BLOCK]
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in batch.columns[:4]), pa.array(bound[i]), pa.array(j, pa.int32()), pa.array(d[i, j])], names=out.names)

    spread = kept(known.select("id", "v", "g", "w", "cell", "bound").mapInArrow(others, out))
    counts = np.zeros(len(points), np.int64)
    for r in spread.groupBy("at").count().collect():
        counts[r["at"]] = r["count"]
    more = _meet(spread, members, facts["n"], counts, rule)
    found = _chosen(first.unionByName(more))
    return queries.select("id").join(found, "id", "left").select("id", "value", "to", "to_g", F.coalesce("measured", F.lit(0)).alias("measured"))


def nearest(vectors: DataFrame, reps: DataFrame, threshold: float | None = None, vector: str = "embedding", key: str = "vec_id", n_pivots: int = PIVOTS) -> DataFrame:
    """(key, label, dist, measured): each vector's nearest of very many representatives (rep_id long, label, vector), exactly.

    The lowest label on ties, -1 beyond the threshold, as ``clustering.assign`` gives; ``key`` is a unique long.
    """
    members = reps.select(F.col("rep_id").alias("id"), F.col(vector).alias("v"), F.col("label").alias("g"), F.lit(0.0).alias("w"))
    queries = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.lit(0).alias("g"), F.lit(1.0).alias("w"))
    found = search(queries, members, Rule(by_group=True), pivots(reps, n_pivots, vector, "rep_id"))
    far = F.col("value").isNull() | (F.col("value") > (float("inf") if threshold is None else threshold))
    return found.select(F.col("id").alias(key), F.when(far, -1).otherwise(F.col("to_g")).cast("int").alias("label"), F.coalesce("value", F.lit(float("inf"))).alias("dist"), "measured")


def worst_ratios(clusters: DataFrame, n_pivots: int = PIVOTS) -> DataFrame:
    """(label, ratio, measured) for clusters (label long, centroid, radius): the largest (r_i + r_j) / d_ij to another one, 0 where there is none."""
    rows = clusters.select(F.col("label").alias("id"), F.col("centroid").alias("v"), F.col("label").alias("g"), F.col("radius").alias("w"))
    found = search(rows, rows, Rule(other=True), pivots(clusters, n_pivots, "centroid", "label"))
    return found.select(F.col("id").alias("label"), F.coalesce(F.try_divide(F.lit(1.0), F.col("value")), F.lit(0.0)).alias("ratio"), "measured")
