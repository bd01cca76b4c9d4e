"""Greedy removal of messages that imply infeasible speeds.

Messages are nodes, infeasible pairs edges.  Again and again the message with the most edges
left (the first on ties) is an outlier and its edges go, until none are left.  A removal changes
the counts of its neighbours only, so stretches of a voyage that no edge connects are independent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.geodesic import inverse
from driftline.schema import EDGE_LEAST_S, EDGE_REACH, KNOT, SPEED_MAX

from .voyages import indexed

#: A sphere's radius in metres, and how far, as a share, a distance on it may be from the geodesic (0.6 % at most).
SPHERE, MARGIN = 6371008.8, 0.01


Choice = Callable[[list[tuple[int, int]]], list[int]]


def greedy(edges: list[tuple[int, int]]) -> list[int]:
    """The outliers among the ends of ``edges``."""
    nodes = sorted({n for e in edges for n in e})
    place = {n: i for i, n in enumerate(nodes)}
    near: list[set[int]] = [set() for _ in nodes]
    for a, b in edges:
        near[place[a]].add(place[b])
        near[place[b]].add(place[a])
    left = np.array([len(s) for s in near])
    out = []
    while len(left) and left.max() > 0:
        worst = int(left.argmax())
        out.append(nodes[worst])
        left[worst] = 0
        for n in near[worst]:
            near[n].discard(worst)
            left[n] = max(left[n] - 1, 0)
    return out


def _fast(rows: dict[str, np.ndarray], speed_max: float = SPEED_MAX) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of messages of a voyage, at most ``EDGE_REACH`` apart, between which the speed is infeasible.

    The distance on a sphere decides but near the limit, where the geodesic does.
    """
    starts, ends, limit = [], [], speed_max * KNOT
    lat, lon = np.radians(rows["lat"]), np.radians(rows["lon"])
    for reach in range(1, EDGE_REACH + 1):
        a, b = slice(None, -reach), slice(reach, None)
        dt = rows["ts_s"][b] - rows["ts_s"][a]
        half = np.sin((lat[b] - lat[a]) / 2) ** 2 + np.cos(lat[a]) * np.cos(lat[b]) * np.sin((lon[b] - lon[a]) / 2) ** 2
        round_way = 2 * SPHERE * np.arcsin(np.sqrt(np.minimum(half, 1)))
        may = (rows["mmsi"][a] == rows["mmsi"][b]) & (rows["voyage"][a] == rows["voyage"][b]) & (dt > EDGE_LEAST_S) & (round_way * (1 + MARGIN) > limit * dt)
        at = np.flatnonzero(may)
        near = at[round_way[at] * (1 - MARGIN) <= limit * dt[at]]
        way = inverse(rows["lat"][near], rows["lon"][near], rows["lat"][near + reach], rows["lon"][near + reach])
        at = np.setdiff1d(at, near[~(way / dt[near] > limit)], assume_unique=True)
        starts.append(at)
        ends.append(at + reach)
    a, b = np.concatenate(starts), np.concatenate(ends)
    order = np.lexsort((b, a))
    return a[order], b[order]


def _outliers(a: np.ndarray, b: np.ndarray, choose: Choice) -> list[int]:
    """The choice in each stretch that edges (sorted by ``a``, then ``b``) connect."""
    out: list[int] = []
    if len(a):
        apart = np.flatnonzero(a[1:] > np.maximum.accumulate(b)[:-1]) + 1
        for part in np.split(np.arange(len(a)), apart):
            out += choose(list(zip(a[part].tolist(), b[part].tolist(), strict=True)))
    return out


def marked(voyages: DataFrame, speed_max: float = SPEED_MAX, choose: Choice = greedy) -> DataFrame:
    """The messages with ``idx``, their place in the voyage, and ``outlier``, in one pass over the partitioning by vessel.

    ``speed_max`` is in knots; ``choose`` names the outliers among the ends of a stretch's infeasible pairs.

    A task reads its messages in order and keeps back only the stretch that messages to come may
    still be connected with.
    """
    rows = indexed(voyages)
    out = T.StructType([*rows.schema.fields, T.StructField("outlier", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        kept: pa.Table | None = None

        def done(part: pa.Table, bad: list[int]) -> Iterator[pa.RecordBatch]:
            flag = np.zeros(part.num_rows, bool)
            flag[bad] = True
            columns = [c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)]
            yield from pa.table([*columns, pa.array(flag)], schema=arrow).to_batches()

        def facts(table: pa.Table) -> dict[str, np.ndarray]:
            return {c: table.column(c).to_numpy() for c in ("mmsi", "voyage", "ts_s", "lat", "lon")}

        for batch in batches:
            one = pa.Table.from_batches([batch])
            kept = one if kept is None else pa.concat_tables([kept, one])
            a, b = _fast(facts(kept), speed_max)
            sure = max(0, kept.num_rows - EDGE_REACH)
            covered = np.zeros(kept.num_rows + 1, np.int64)
            np.add.at(covered, a + 1, 1)
            np.add.at(covered, b + 1, -1)
            free = np.flatnonzero(np.cumsum(covered)[: sure + 1] == 0)
            at = int(free[-1]) if len(free) else 0
            if at:
                yield from done(kept.slice(0, at), _outliers(a[a < at], b[a < at], choose))
                kept = kept.slice(at).combine_chunks()
        if kept is not None and kept.num_rows:
            yield from done(kept, _outliers(*_fast(facts(kept), speed_max), choose))

    return rows.sortWithinPartitions("mmsi", "voyage", "idx").mapInArrow(run, out)


def flagged(voyages: DataFrame, speed_max: float = SPEED_MAX, choose: Choice = greedy) -> DataFrame:
    """(mmsi, voyage, idx) of the outliers."""
    return marked(voyages, speed_max, choose).filter("outlier").select("mmsi", "voyage", "idx")


def candidates(voyages: DataFrame, speed_max: float = SPEED_MAX) -> DataFrame:
    """The messages without those that report more than ``speed_max`` knots, and without voyages of fewer than two."""
    slow = voyages.filter(F.coalesce(F.col("sog") <= speed_max, F.lit(True)))
    counted = slow.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("mmsi", "voyage")))
    return counted.filter("_n >= 2").drop("_n")


def clean(voyages: DataFrame, speed_max: float = SPEED_MAX, choose: Choice = greedy) -> DataFrame:
    """The messages that aren't outliers; a voyage of fewer than two messages, or of outliers only, goes.

    Messages that report more than ``speed_max`` knots go first.
    """
    return marked(candidates(voyages, speed_max), speed_max, choose).filter("not outlier").drop("idx", "outlier")
