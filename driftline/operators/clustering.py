"""Hierarchical clustering of a bounded sample, and distributed assignment and quality measures."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.hashing import first_by_hash
from driftline.scratch import kept

#: Rows of vectors that are compared with each other in one task.
BLOCK = 2048
#: Clusters that are compared with each other in one value, at most.
MOST_IN_ONE = 1000
#: Blocks of clusters, each pair of which meets under one key.
PAIR_BLOCKS = 16
LINKAGES = ("ward", "single", "average")
#: Numbers of a block of differences between vectors.
PAIR_NUMBERS = 1 << 20


def cluster_distance(a: np.ndarray, b: np.ndarray, linkage: str) -> float:
    """ward: squared centroid distance times n1 n2 / (n1 + n2); single: least; average: mean over pairs."""
    if linkage == "ward":
        gap = a.mean(0) - b.mean(0)
        return float(gap @ gap) * len(a) * len(b) / (len(a) + len(b))
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    return float(d.min() if linkage == "single" else d.mean())


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``y``, some rows at a time."""
    out = np.empty((len(x), len(y)))
    rows = max(1, PAIR_NUMBERS // max(1, y.size))
    for at in range(0, len(x), rows):
        out[at : at + rows] = ((x[at : at + rows, None] - y[None]) ** 2).sum(-1)
    return out


@dataclass
class Agglomeration:
    """Greedy merging of the closest pair; the first pair by cluster order wins ties.

    The distances between clusters are kept in one matrix and updated at a merge, so a step
    costs one row.  Once, when the clusters are at most ``pruning_fraction`` of the points,
    those of ``pruning_min_size`` points or fewer are noise.
    """

    linkage: str = "average"
    pruning_fraction: float | None = None
    pruning_min_size: int = 1
    merges: list[tuple[int, int, float, int]] = field(default_factory=list)
    noise: list[int] = field(default_factory=list)
    n: int = 0

    def fit(self, x: np.ndarray) -> Agglomeration:
        if self.linkage not in LINKAGES:
            raise ValueError(f"linkage must be one of {LINKAGES}")
        x = np.asarray(x, float)
        self.n, self.merges, self.noise = len(x), [], []
        if not len(x):
            return self
        square = squares(x, x)
        d = square / 2 if self.linkage == "ward" else np.sqrt(square)
        np.fill_diagonal(d, np.inf)
        names, sizes, members = list(range(len(x))), [1] * len(x), [[i] for i in range(len(x))]
        alive = np.ones(len(x), bool)
        order = list(range(len(x)))
        pruned = self.pruning_fraction is None
        following = len(x)
        while len(order) > 1:
            if not pruned and len(order) <= self.n * self.pruning_fraction:
                pruned = True
                for s in [s for s in order if sizes[s] <= self.pruning_min_size]:
                    self.noise += members[s]
                    order.remove(s)
                    alive[s] = False
                    d[s] = d[:, s] = np.inf
                if len(order) < 2:
                    break
            at = np.array(order)
            sub = np.triu(d[np.ix_(at, at)], 1) + np.tril(np.full((len(at), len(at)), np.inf))
            i, j = divmod(int(sub.argmin()), len(at))
            a, b = order[i], order[j]
            best, na, nb = float(d[a, b]), sizes[a], sizes[b]
            self.merges.append((names[a], names[b], best, na + nb))
            others = at[(at != a) & (at != b)]
            if self.linkage == "ward":
                m = np.array([sizes[o] for o in others])
                new = ((m + na) * d[a, others] + (m + nb) * d[b, others] - m * best) / (m + na + nb) if len(others) else np.zeros(0)
            elif self.linkage == "single":
                new = np.minimum(d[a, others], d[b, others])
            else:
                new = (na * d[a, others] + nb * d[b, others]) / (na + nb)
            d[a, others] = d[others, a] = new
            sizes[a], members[a], names[a] = na + nb, members[a] + members[b], following
            following += 1
            alive[b] = False
            order.remove(b)
            order.remove(a)
            order.append(a)
        return self

    def labels(self, n_clusters: int) -> np.ndarray:
        """A cluster for each point, numbered by ascending cluster id; noise is -1.

        Merges are replayed until ``n_clusters`` clusters that aren't noise are left.
        """
        groups = {i: [i] for i in range(self.n)}
        noise = set(self.noise)
        live = lambda: sum(not set(m) <= noise for m in groups.values())
        following = self.n
        left = live()
        for a, b, _, _ in self.merges:
            if left <= n_clusters:
                break
            both = {a: set(groups[a]) <= noise, b: set(groups[b]) <= noise}
            groups[following] = groups.pop(a) + groups.pop(b)
            left -= not (both[a] or both[b])
            following += 1
        out = np.full(self.n, -1)
        kept = [g for g in sorted(groups) if not set(groups[g]) <= noise]
        for label, g in enumerate(kept):
            out[groups[g]] = label
        out[list(noise)] = -1
        return out

    def linkage_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, int(a), int(b), float(d), int(s)) for i, (a, b, d, s) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "step int, c1 int, c2 int, dist double, size int")

    def dendrogram_frame(self, spark: SparkSession, last: int | None = None) -> DataFrame:
        rows = [(i, int(a), int(b), float(d), int(s)) for i, (a, b, d, s) in enumerate(self.dendrogram(last))]
        return spark.createDataFrame(rows, "step int, c1 int, c2 int, dist double, size int")

    def dendrogram(self, last: int | None = None) -> list[tuple[int, int, float, int]]:
        """The merges with ids renumbered over the points that aren't noise; the last ones only, if asked."""
        noise = set(self.noise)
        new = {p: i for i, p in enumerate(p for p in range(self.n) if p not in noise)}
        out, following = [], len(new)
        members = {i: {i} for i in range(self.n)}
        for step, (a, b, d, s) in enumerate(self.merges):
            members[self.n + step] = members[a] | members[b]
            if members[self.n + step] <= noise:
                continue
            if a in new and b in new:
                out.append((new[a], new[b], d, s))
                new[self.n + step] = following
                following += 1
            else:
                new[self.n + step] = new[a] if a in new else new[b]
        return out[-last:] if last else out


def representatives(points: np.ndarray, n: int, compression: float) -> np.ndarray:
    """At most ``n`` points, farthest first from the centroid and then from each other, drawn towards the centroid."""
    if not len(points):
        return points
    centre = points.mean(0)
    if len(points) <= n:
        chosen = points
    else:
        at = [int(np.sqrt(((points - centre) ** 2).sum(1)).argmax())]
        near = np.sqrt(((points - points[at[0]]) ** 2).sum(1))
        while len(at) < n:
            at.append(int(near.argmax()))
            near = np.minimum(near, np.sqrt(((points - points[at[-1]]) ** 2).sum(1)))
        chosen = points[at]
    return chosen + compression * (centre - chosen)


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's vectors as rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def nearest(x: np.ndarray, clusters: np.ndarray, points: np.ndarray, threshold: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cluster (the lowest on ties, -1 beyond the threshold) and its distance to the nearest point."""
    if not len(points):
        return np.full(len(x), -1), np.full(len(x), np.inf)
    d = squares(x, points)
    best = d.argmin(1)
    near = np.sqrt(d[np.arange(len(x)), best])
    return np.where(near > (np.inf if threshold is None else threshold), -1, clusters[best]), near


def assign(vectors: DataFrame, reps: list[tuple[int, np.ndarray]], threshold: float | None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The key, the nearest representative's cluster (the lowest on ties, -1 beyond the threshold) and the distance.

    The representatives come from a bounded sample, so they are sent to every worker.
    """
    return assign_each(vectors, {0: reps}, threshold, vector, key).drop("n_clusters")


def assign_each(vectors: DataFrame, reps: dict[int, list[tuple[int, np.ndarray]]], threshold: float | None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``assign`` for several sets of representatives, by their name ``n_clusters``, in one pass over the vectors."""
    each = {}
    for k, of in reps.items():
        of = sorted(((c, np.asarray(r, float)) for c, r in of), key=lambda x: x[0])
        each[k] = np.array([c for c, _ in of]), np.array([r for _, r in of])
    sent = vectors.sparkSession.sparkContext.broadcast(each)
    out = T.StructType([T.StructField("n_clusters", T.IntegerType()), vectors.schema[key], T.StructField("label", T.IntegerType()), T.StructField("dist", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = matrix(batch.column(1))
                for k, (clusters, points) in sent.value.items():
                    label, near = nearest(x, clusters, points, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k), pa.int32()), batch.column(0), pa.array(label, pa.int32()), pa.array(near)], names=out.names)

    return vectors.select(key, vector).mapInArrow(run, out)


class Cure:
    """Clustering by representatives: a uniform sample is merged, everything is assigned."""

    def __init__(self, sample_size: int = 1000, linkage: str = "average", n_representatives: int = 20, compression: float = 0.2, threshold: float | None = None, seed: int = 42, pruning_fraction: float | None = None, pruning_min_size: int = 1):
        self.sample_size, self.linkage, self.seed = sample_size, linkage, seed
        self.n_representatives, self.compression, self.threshold = n_representatives, compression, threshold
        self.pruning_fraction, self.pruning_min_size = pruning_fraction, pruning_min_size
        self.model: Agglomeration | None = None
        self.sample = np.zeros((0, 0))
        self.fitted: tuple[DataFrame, str, str] | None = None

    def sampled(self, vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
        """(nth, key, vector) of the sample: the ``sample_size`` rows with the smallest hashes of key and seed, in that order."""
        chosen = first_by_hash(vectors.select(key, vector), self.sample_size, key, seed=self.seed)
        # at most sample_size rows
        nth = F.row_number().over(Window.orderBy("_order", key, vector)) - 1
        return chosen.select(nth.cast("int").alias("nth"), key, vector)

    def fit(self, vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> Cure:
        rows = self.sampled(vectors, vector, key).collect()
        self.sample = np.array([r[vector] for r in sorted(rows, key=lambda r: r["nth"])], float)
        self.model = Agglomeration(self.linkage, self.pruning_fraction, self.pruning_min_size).fit(self.sample)
        self.fitted = vectors, vector, key
        return self

    def labels(self, n_clusters: int) -> DataFrame:
        """The key and label of every row that the model was fitted on."""
        if self.fitted is None:
            raise RuntimeError("the model was not fitted in this session: there is no data to label")
        vectors, vector, key = self.fitted
        return self.predict(vectors, n_clusters, vector=vector, key=key).select(key, "label")

    def evaluate(self, vectors: DataFrame, n_clusters: tuple[int, ...] = (2, 5, 10, 20), vector: str = "embedding", key: str = "vec_id") -> DataFrame:
        """(n_clusters, davies_bouldin, noise_pct): noise is left out of the index, which is null without a cluster.

        Two passes over the vectors, all numbers of clusters at once: sums for the centroids, then
        distances to them.  What reaches the driver is a row for each cluster.
        """
        spark = vectors.sparkSession
        reps = {k: self.representatives(k) for k in n_clusters}
        sent = spark.sparkContext.broadcast({k: (np.array([c for c, _ in r]), np.array([p for _, p in r])) for k, r in reps.items()})
        threshold = self.threshold

        def passed(centres: Broadcast | None) -> DataFrame:
            out = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("label", T.IntegerType()), T.StructField("total", T.ArrayType(T.DoubleType()))])

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                totals: dict[tuple[int, int], np.ndarray] = {}
                for batch in batches:
                    x = matrix(batch.column(0)) if batch.num_rows else np.zeros((0, 0))
                    for k, (clusters, points) in sent.value.items() if len(x) else ():
                        label, _ = nearest(x, clusters, points, threshold)
                        for c in np.unique(label).tolist():
                            rows = x[label == c]
                            if centres is not None:
                                rows = np.sqrt(((rows - centres.value[k, c]) ** 2).sum(1, keepdims=True))
                            totals[k, c] = totals.get((k, c), 0.0) + np.concatenate([[len(rows)], rows.sum(0)])
                if totals:
                    keys = sorted(totals)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int32()), pa.array([totals[x].tolist() for x in keys], pa.list_(pa.float64()))],
                        names=out.names,
                    )

            parts = vectors.select(vector).mapInArrow(run, out)
            sums = parts.select("k", "label", F.posexplode("total").alias("pos", "v")).groupBy("k", "label", "pos").agg(F.sum("v").alias("v"))
            # the first number of a cluster is its size
            return sums.groupBy("k", "label").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("v")).select("k", "label", F.col("v.v").alias("total"))

        sums = passed(None).collect()
        centres = {(r["k"], r["label"]): np.array(r["total"][1:]) / r["total"][0] for r in sums}
        radii = {(r["k"], r["label"]): r["total"][1] / r["total"][0] for r in passed(spark.sparkContext.broadcast(centres)).collect()}
        rows = []
        for k in n_clusters:
            sizes = {r["label"]: r["total"][0] for r in sums if r["k"] == k}
            live = sorted(c for c in sizes if c != -1)
            worst = []
            for i in live:
                gaps = [(radii[k, i] + radii[k, j], float(np.sqrt(((centres[k, i] - centres[k, j]) ** 2).sum()))) for j in live if j != i]
                worst.append(max((r / d for r, d in gaps if d > 0), default=0.0))
            rows.append((k, float(np.mean(worst)) if worst else None, 100.0 * sizes.get(-1, 0) / sum(sizes.values()) if sizes else None))
        return spark.createDataFrame(rows, "n_clusters int, davies_bouldin double, noise_pct double")

    def representatives(self, n_clusters: int) -> list[tuple[int, np.ndarray]]:
        if self.model is None:
            raise RuntimeError("the model is not fitted")
        if n_clusters < 1:
            raise ValueError("there must be a cluster")
        labels = self.model.labels(n_clusters)
        return [(k, r) for k in range(n_clusters) for r in representatives(self.sample[labels == k], self.n_representatives, self.compression)]

    def predict(self, vectors: DataFrame, n_clusters: int, threshold: float | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
        return assign(vectors, self.representatives(n_clusters), self.threshold if threshold is None else threshold, vector, key)

    def save(self, spark: SparkSession, path: str) -> None:
        """Parquet for the merges, noise and sample, JSON for the settings."""
        if self.model is None:
            raise RuntimeError("the model is not fitted")
        self.model.linkage_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
        rows = [(i, [float(v) for v in x], i in set(self.model.noise)) for i, x in enumerate(self.sample)]
        spark.createDataFrame(rows, "nth int, vector array<double>, noise boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/sample")
        names = ("sample_size", "linkage", "n_representatives", "compression", "threshold", "seed", "pruning_fraction", "pruning_min_size")
        spark.createDataFrame([(json.dumps({n: getattr(self, n) for n in names}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cure:
        out = cls(**json.loads(spark.read.text(f"{path}/meta").first()[0]))
        rows = sorted(spark.read.parquet(f"{path}/sample").collect(), key=lambda r: r["nth"])
        out.sample = np.array([r["vector"] for r in rows], float)
        merges = sorted(spark.read.parquet(f"{path}/merges").collect(), key=lambda r: r["step"])
        out.model = Agglomeration(out.linkage, out.pruning_fraction, out.pruning_min_size, [(r["c1"], r["c2"], r["dist"], r["size"]) for r in merges], [r["nth"] for r in rows if r["noise"]], len(rows))
        return out


def parts(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(label, pos, mean, n) of each cluster's centroid."""
    long = vectors.select("label", F.posexplode(vector).alias("pos", "v"))
    return long.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def centroids(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(label, centroid, n): at most a row for each cluster."""
    return parts(vectors, vector).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("centroid"), F.max("n").alias("n"))


def with_centroid_distance(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    from driftline.functions.vectors import distance

    return vectors.join(centroids(vectors, vector), "label").withColumn("dist", distance(vector, "centroid"))


def radii(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return with_centroid_distance(vectors, vector).groupBy("label").agg(F.avg("dist").alias("radius"))


def davies_bouldin(vectors: DataFrame, vector: str = "embedding", include_noise: bool = False, most: int = MOST_IN_ONE) -> DataFrame:
    """One row: the mean over clusters of the worst (r_i + r_j) / d_ij; 0 for one cluster.  Coincident centroids are left out.

    Up to ``most`` clusters are compared with each other in one value; more, whose labels must be
    numbers, by cells, which measure only pairs that can be a cluster's worst.
    """
    from driftline.functions.vectors import distance

    rows = vectors if include_noise else vectors.filter("label <> -1")
    facts = with_centroid_distance(rows, vector).groupBy("label").agg(F.avg("dist").alias("r"), F.any_value("centroid").alias("c"))
    if rows.select("label").distinct().limit(most + 1).count() > most:
        from . import cells

        clusters = kept(facts.select(F.col("label").cast("long").alias("label"), F.col("c").alias("centroid"), F.col("r").alias("radius")))
        return cells.worst_ratios(clusters).agg(F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("davies_bouldin"))
    all_of = facts.agg(F.collect_list(F.struct("label", "r", "c")).alias("f"))
    gap = lambda x, y: distance(x["c"], y["c"])
    ratio = lambda x, y: F.try_divide(x["r"] + y["r"], gap(x, y))
    worst = F.transform("f", lambda x: F.coalesce(F.array_max(F.transform(F.filter("f", lambda y: y["label"] != x["label"]), lambda y: ratio(x, y))), F.lit(0.0)))
    return all_of.select(F.coalesce(F.try_divide(F.aggregate(worst, F.lit(0.0), lambda a, x: a + x), F.size("f")), F.lit(0.0)).alias("davies_bouldin"))


def ward(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(i, j, ward) of every pair of clusters i < j, from centroids and sizes alone."""
    from driftline.functions.vectors import distance

    facts = centroids(vectors, vector)
    x = facts.select(F.col("label").alias("i"), F.col("centroid").alias("ci"), F.col("n").alias("ni"))
    y = facts.select(F.col("label").alias("j"), F.col("centroid").alias("cj"), F.col("n").alias("nj"))
    # every pair meets under one pair of blocks: an equal join, whose sides are as large as the clusters ask for
    every = F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(PAIR_BLOCKS)).cast("int")
    x = x.select("*", of("i").alias("p"), F.explode(every).alias("q"))
    y = y.select("*", F.explode(every).alias("p"), of("j").alias("q"))
    both = x.join(y, ["p", "q"]).filter("i < j").withColumn("d", distance("ci", "cj"))
    return both.select("i", "j", (F.col("d") * F.col("d") * F.col("ni") * F.col("nj") / (F.col("ni") + F.col("nj"))).alias("ward"))


def pair_singles(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(i, j, single) of every pair of clusters i < j: the least distance of all pairs of members, without their mean.

    A cluster's equal vectors count once.  Pairs meet in blocks as for ``pair_linkages``; single precision rules out
    all but the few that may be the least.
    """
    from . import blocks

    rows = vectors.filter(F.col("label").isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), "label", F.col(vector).alias("v"))
    rows = kept(rows.groupBy("label", "v").agg(F.min("id").alias("id")).select("id", "label", "v"))
    out = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("least", T.DoubleType())])

    def measure(left: pa.Table, x: np.ndarray, right: pa.Table, y: np.ndarray, one: bool) -> pa.Table:
        labels = [s.column("label").to_numpy() for s in (left, right)]
        # members of a cluster lie next to each other
        by = [np.argsort(n, kind="stable") for n in labels]
        (a, of_a), (b, of_b) = (np.unique(n[o], return_inverse=True) for n, o in zip(labels, by, strict=True))
        # in one block both ends of a pair of clusters are met twice over: those with i < j count
        i, j, least = _leasts(x[by[0]], y[by[1]], of_a, of_b, a[:, None] < b if one else a[:, None] != b, one)
        return pa.table([pa.array(np.minimum(a[i], b[j]), pa.int32()), pa.array(np.maximum(a[i], b[j]), pa.int32()), pa.array(least, pa.float64())], names=out.names)

    met = blocks.met(rows, blocks.how_many(rows.count(), blocks.width(rows)), measure, out)
    return met.groupBy("i", "j").agg(F.min("least").alias("single"))


def _leasts(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, asked: np.ndarray, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance): the least distance of the rows of ``x`` in group i and those of ``y`` in group j, for the pairs of groups asked for.

    Groups are numbers that rise.  What a tile's rounding lets be the least is measured by differences; a tile that
    single precision leaves too much of is made again in double precision.
    """
    from . import blocks

    least = np.full(asked.shape, np.inf)
    unit = blocks.single(x, y)
    rough = blocks.rounding(x, y, unit)
    for r, c, d in blocks.tiles(x, y, same, unit):
        of_a, of_b = of_x[r : r + len(d)], of_y[c : c + d.shape[1]]
        at = [np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) for o in (of_a, of_b)]
        here = np.ix_(of_a[at[0]], of_b[at[1]])
        wanted = asked[here] & (least[here] > 0)

        def open_pairs(d: np.ndarray, off: float, square: float) -> tuple[np.ndarray, np.ndarray]:
            low = np.minimum.reduceat(np.minimum.reduceat(d, at[1], axis=1), at[0], axis=0).astype(float) * square  # noqa: B023
            most = least[here] ** 2 * (1 + 1e-12) + off  # noqa: B023
            # below none of a pair's own squares where it has no new least one
            most = np.where(wanted & (low <= most), np.minimum(most, low + 2 * off), -np.inf)  # noqa: B023
            if np.isneginf(most).all():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            most = (most / square * (1 + 1e-6)).astype(d.dtype)
            for axis, (o, n) in enumerate(zip(at, d.shape, strict=True)):  # noqa: B023
                most = np.repeat(most, np.diff(np.r_[o, n]), axis)
            return np.divmod(np.flatnonzero((d <= most).ravel()), d.shape[1])

        p, q = open_pairs(d, rough, unit * unit or 1.0)
        if unit and len(p) > max(d.size // blocks.FEW_OF, 64):
            left, right = x[r : r + len(d)], y[c : c + d.shape[1]]
            p, q = open_pairs(next(blocks.tiles(left, right))[2], blocks.rounding(left, right), 1.0)
        if len(p):
            np.minimum.at(least, (of_a[p], of_b[q]), blocks.lengths(x, y, p + r, q + c))
    i, j = np.nonzero(asked)
    return i, j, least[i, j]


def pair_linkages(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(i, j, single, average) of every pair of clusters i < j.

    These are defined over all pairs of members.  The vectors are dealt to blocks, each pair of
    blocks meets in one task, and a task sends a row for each pair of clusters only.
    """
    from . import blocks

    rows = vectors.filter(F.col("label").isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), "label", F.col(vector).alias("v"))
    out = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("least", T.DoubleType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])

    def measure(left: pa.Table, x: np.ndarray, right: pa.Table, y: np.ndarray, one: bool) -> pa.Table:
        # members of a cluster lie next to each other
        by = [np.argsort(s.column("label").to_numpy(), kind="stable") for s in (left, right)]
        x, y = x[by[0]], y[by[1]]
        la, lb = (s.column("label").to_numpy()[b] for s, b in zip((left, right), by, strict=True))
        names, of = np.unique(np.concatenate([la, lb]), return_inverse=True)
        of_a, of_b = of[: len(la)], of[len(la) :]
        off = 2 * blocks.rounding(x, y)
        sums: dict[tuple[int, int], list] = {}
        # in one block both ends of a pair of clusters are met twice over: those with i < j count
        for r, c, d in blocks.tiles(x, y, one):
            rows_of, columns_of = of_a[r : r + len(d)], of_b[c : c + d.shape[1]]
            at_a, at_b = (np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) for o in (rows_of, columns_of))
            low = np.minimum.reduceat(np.minimum.reduceat(d, at_b, axis=1), at_a, axis=0)
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            total = np.add.reduceat(np.add.reduceat(d, at_b, axis=1), at_a, axis=0)
            n_a, n_b = np.diff(np.r_[at_a, len(rows_of)]), np.diff(np.r_[at_b, len(columns_of)])
            for k, i in enumerate(rows_of[at_a].tolist()):
                for m, j in enumerate(columns_of[at_b].tolist()):
                    if i == j or (one and i > j):
                        continue
                    s = sums.setdefault((min(i, j), max(i, j)), [np.inf, 0.0, 0])
                    s[1], s[2] = s[1] + total[k, m], s[2] + int(n_a[k]) * int(n_b[m])
                    if s[0] > 0 and low[k, m] <= s[0] ** 2 + off:
                        # the least one is measured anew, by differences, among all that rounding lets be it
                        part = d[at_a[k] : at_a[k] + n_a[k], at_b[m] : at_b[m] + n_b[m]]
                        p, q = np.nonzero(part <= np.sqrt(max(low[k, m], 0) + off))
                        s[0] = min(s[0], _least(x[r + at_a[k] :], y[c + at_b[m] :], p, q))
        found = [(int(names[i]), int(names[j]), *s) for (i, j), s in sums.items()]
        return pa.table([pa.array(v, t) for v, t in zip(zip(*found, strict=True) if found else [()] * 5, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=out.names)

    met = blocks.met(rows, blocks.how_many(rows.count(), blocks.width(rows)), measure, out)
    return met.groupBy("i", "j").agg(F.min("least").alias("single"), (F.sum("total") / F.sum("n")).alias("average"))


def _least(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> float:
    """The least distance of some pairs, by differences; none is less than 0."""
    from . import blocks

    least = np.inf
    for at in range(0, len(i), BLOCK):
        least = min(least, float(blocks.lengths(x, y, i[at : at + BLOCK], j[at : at + BLOCK]).min()))
        if least == 0:
            break
    return least
