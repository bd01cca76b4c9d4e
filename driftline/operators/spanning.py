"""Single linkage of all vectors, not of a sample, by a minimum spanning tree.

The merges of single linkage are the tree's edges by length.  The tree is grown in rounds (Borůvka): each
component's shortest edge to another one is in it.  A round is one search by cells, in which only
the best of a component counts, so a vector that can't have its component's shortest edge is left
with what its own cell shows.  Edges are ordered by length, then by their ends' ids, so ties make no
cycles.  Components at least halve in a round.

Where only edges up to a length matter, there is one search: all pairs in blocks, each of
which keeps the lightest forest of its own pairs that are short enough, as no other of its edges can be in the tree.
The forests together are few edges, and the rounds need no vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.scratch import kept

from . import blocks
from .cells import PIVOTS, Rule, pivots, search
from .features import shifted

#: Edges that a task holds before it drops those that are in no lightest forest.
HELD = 1 << 20

_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("dist", T.DoubleType())])


@dataclass
class Tree:
    """``edges`` (a, b, dist) with a < b, the distances measured and the rounds it took."""

    edges: DataFrame
    measured: int
    rounds: int


def _roots(to: DataFrame) -> DataFrame:
    """(g, root) of components (g, p) that each point at another one; two that point at each other end a chain."""
    back = to.select(F.col("g").alias("p"), F.col("p").alias("of_p"))
    at = kept(to.join(back, "p", "left").select("g", F.when((F.col("of_p") == F.col("g")) & (F.col("g") < F.col("p")), F.col("g")).otherwise(F.col("p")).alias("p")))
    while True:
        ahead = at.select(F.col("g").alias("p"), F.col("p").alias("further"))
        further = kept(at.join(ahead, "p", "left").select("g", F.coalesce("further", "p").alias("p"), (F.coalesce("further", "p") != F.col("p")).alias("moved")))
        at = further.select("g", "p")
        if further.filter("moved").isEmpty():
            return at.withColumnRenamed("p", "root")


def lightest(a: np.ndarray, b: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """The places of the edges that are in the lightest forest, ordered by length and ends."""
    order = np.lexsort((b, a, dist))
    nodes, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root, chosen, live = np.arange(len(nodes)), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        apart = root[u[live]] != root[v[live]]
        live = live[apart]
        if not len(live):
            return order[chosen]
        best = np.full(len(nodes), len(a))
        for side in (u, v):
            # edges rise, so what is written last is a component's first
            first = np.full(len(nodes), len(a))
            first[root[side[live[::-1]]]] = live[::-1]
            best = np.minimum(best, first)
        some = np.flatnonzero(best < len(a))
        edge = best[some]
        chosen[edge] = True
        to = np.arange(len(nodes))
        to[some] = np.where(root[u[edge]] == some, root[v[edge]], root[u[edge]])
        to[some] = np.where((to[to[some]] == some) & (some < to[some]), some, to[some])
        while (to[to] != to).any():
            to = to[to]
        root = to[root]


def _joined(edges: DataFrame) -> tuple[DataFrame, int]:
    """The lightest forest of edges (a, b, dist), and the rounds it took."""
    live = kept(edges.select("a", "b", "dist", F.col("a").alias("ga"), F.col("b").alias("gb")))
    forest, rounds = None, 0
    while True:
        ends = [live.select(F.col(g).alias("g"), F.struct("dist", "a", "b", F.col(h).alias("p")).alias("e")) for g, h in (("ga", "gb"), ("gb", "ga"))]
        best = kept(ends[0].unionByName(ends[1]).groupBy("g").agg(F.min("e").alias("e")).select("g", "e.p", "e.a", "e.b", "e.dist"))
        if best.isEmpty():
            return (best.select("a", "b", "dist") if forest is None else forest), rounds
        rounds += 1
        new = best.select("a", "b", "dist").distinct()
        forest = new if forest is None else forest.unionByName(new)
        roots = _roots(best.select("g", "p"))
        for g in ("ga", "gb"):
            live = live.join(roots.select(F.col("g").alias(g), "root"), g).drop(g).withColumnRenamed("root", g)
        live = kept(live.filter("ga <> gb"))


def _short(nodes: DataFrame, up_to: float) -> tuple[DataFrame, int]:
    """Edges up to a length, among them all of the tree, and the pairs measured for them."""
    same = kept(nodes.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    # equal vectors hang on the first of them
    copies = nodes.join(same.filter("n > 1").select("v", F.col("id").alias("a")), "v").filter("id <> a").select("a", F.col("id").alias("b"), F.lit(0.0).alias("dist"))
    n = same.count()

    def measure(left: pa.Table, x: np.ndarray, right: pa.Table, y: np.ndarray, one: bool) -> pa.Table:
        ids, others = left.column("id").to_numpy(), right.column("id").to_numpy()
        most = up_to * up_to * (1 + 1e-12) + blocks.rounding(x, y)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        more, n_more = [], 0

        def fewer() -> list[np.ndarray]:
            whole = [np.concatenate(c) for c in zip(held, *more, strict=True)]
            at = lightest(*whole)
            return [c[at] for c in whole]

        for r, c, d in blocks.tiles(x, y, one):
            i, j = np.divmod(np.flatnonzero(d.ravel() <= most), d.shape[1])
            i, j = i + r, j + c
            if one:
                i, j = i[i < j], j[i < j]
            dist = blocks.lengths(x, y, i, j)
            near = dist <= up_to
            i, j, dist = i[near], j[near], dist[near]
            if len(i):
                more.append((np.minimum(ids[i], others[j]), np.maximum(ids[i], others[j]), dist))
                n_more += len(i)
            if n_more > HELD:
                held, more, n_more = fewer(), [], 0
        return pa.table(fewer(), names=_EDGE.names)

    found = blocks.met(same.select("id", "v"), blocks.how_many(n, blocks.width(same)), measure, _EDGE)
    return found.unionByName(copies.filter(F.lit(up_to >= 0))), n * (n - 1) // 2


def spanning_tree(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", n_pivots: int = PIVOTS, up_to: float | None = None) -> Tree:
    """The minimum spanning tree of all vectors with a key (a unique long); null vectors and keys are left out.

    With ``up_to`` its edges up to that length, which is all that ``cut_at`` needs for lesser ones.
    """
    usable = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    if up_to is not None:
        short, measured = _short(kept(usable.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))), up_to)
        edges, rounds = _joined(short)
        return Tree(edges, measured, rounds)
    points = pivots(usable, n_pivots, vector, key)
    nodes = kept(usable.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(key).cast("long").alias("g"), F.lit(1.0).alias("w")))
    edges, measured, rounds = None, 0, 0
    while True:
        # a member's weight is 0: a value is a distance
        found = search(nodes, nodes.withColumn("w", F.lit(0.0)), Rule(apart=True), points, shared=True)
        found = kept(found.join(nodes.select("id", "g"), "id"))
        edge = F.struct("value", F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"), "to_g")
        best = kept(found.groupBy("g").agg(F.min(F.when(F.col("to").isNotNull(), edge)).alias("e"), F.sum("measured").alias("measured")))
        measured, rounds = measured + (best.agg(F.sum("measured")).first()[0] or 0), rounds + 1
        best = best.filter("e is not null").select("g", F.col("e.to_g").alias("p"), "e.a", "e.b", F.col("e.value").alias("dist"))
        new = best.select("a", "b", "dist").distinct()
        edges = new if edges is None else edges.unionByName(new)
        if best.isEmpty():
            return Tree(edges, measured, rounds)
        roots = _roots(best.select("g", "p"))
        if roots.select("root").distinct().limit(2).count() < 2:
            return Tree(edges, measured, rounds)
        nodes = kept(nodes.join(roots, "g").select("id", "v", F.col("root").alias("g"), "w"))


def merges(tree: Tree) -> DataFrame:
    """(a, b, dist, rank): the merges of single linkage, from the closest pair on; each joins the clusters of a and b.

    Ranks are made among edges of like length and shifted by those before, so no task sorts them all.
    """
    cells_of = tree.edges.withColumn("_begin", F.floor(F.log2(F.greatest(F.col("dist"), F.lit(1e-300))) * 64).cast("long"))
    within = F.row_number().over(Window.partitionBy("_begin").orderBy("dist", "a", "b"))
    return shifted(cells_of.withColumn("_at", within), cells_of, "_begin", F.count(F.lit(1))).select("a", "b", "dist", (F.col("_at") + F.col("_before") - 1).cast("long").alias("rank"))


def cut_at(tree: Tree, vectors: DataFrame, threshold: float, key: str = "vec_id") -> DataFrame:
    """(key, label): single linkage up to a distance; a cluster's label is its smallest key."""
    at = kept(vectors.select(F.col(key).cast("long").alias("id"), F.col(key).cast("long").alias("label")))
    short = kept(tree.edges.filter(F.col("dist") <= threshold).select("a", "b"))
    both = short.unionByName(short.select(F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        # the smallest label next to each key, and then the label of that label
        near = both.join(at, both["b"] == at["id"]).groupBy("a").agg(F.min("label").alias("low"))
        hop = at.join(near, at["id"] == near["a"], "left").select("id", "label", F.least("label", "low").alias("low"))
        ahead = at.select(F.col("id").alias("low"), F.col("label").alias("lower"))
        moved = kept(hop.join(ahead, "low").select("id", F.least("low", "lower").alias("new"), "label"))
        at = moved.select("id", F.col("new").alias("label"))
        if moved.filter("new < label").isEmpty():
            return at.withColumnRenamed("id", key)
