"""Voyage rules.

Voyages are made over hours of a vessel (``slots``), so that a vessel of any size is spread over tasks;
rules over voyages whose messages have been chosen already are windows over a voyage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftline.functions.geodesic import with_inverse
from driftline.operators import slots
from driftline.schema import (
    CHUNK_TICKS,
    EDGE_LEAST_S,
    EDGE_REACH,
    GAP_S,
    KNOT,
    LEAST_ROWS,
    LEAST_S,
    LEAST_TICKS,
    SLOW_KNOTS,
    SLOW_SHARE,
    SPEED_MAX,
    TICK_S,
)


def by_vessel() -> WindowSpec:
    return Window.partitionBy("mmsi").orderBy("ts_s", "seq")


def by_voyage() -> WindowSpec:
    return Window.partitionBy("mmsi", "voyage").orderBy("ts_s", "seq")


def gaps(messages: DataFrame) -> DataFrame:
    """Seconds since the vessel's message before; null for the first."""
    return slots.with_gaps(messages).drop("voyage")


def split(messages: DataFrame) -> DataFrame:
    """A voyage number for each message: a new one after a gap of more than two hours."""
    return slots.with_gaps(messages)


def long_messages(messages: DataFrame) -> DataFrame:
    """The messages of long voyages with their voyage, neither sorted nor dealt by vessel."""
    return slots.placed(messages, "voyage", only_long=True).drop("_slot")


def stats(voyages: DataFrame) -> DataFrame:
    return voyages.groupBy("mmsi", "voyage").agg(F.count(F.lit(1)).alias("n"), F.min("ts_s").alias("t0"), F.max("ts_s").alias("tn"))


def long_stats(voyages: DataFrame) -> DataFrame:
    """Voyages of 20 messages or more over four hours or more."""
    return stats(voyages).filter((F.col("n") >= LEAST_ROWS) & (F.col("tn") - F.col("t0") >= LEAST_S))


def long_voyages(voyages: DataFrame) -> DataFrame:
    """The messages of long voyages; counted over the same partitioning by vessel, so nothing is shuffled again."""
    w = Window.partitionBy("mmsi", "voyage")
    counted = voyages.withColumns({"_n": F.count(F.lit(1)).over(w), "_s": F.max("ts_s").over(w) - F.min("ts_s").over(w)})
    return counted.filter((F.col("_n") >= LEAST_ROWS) & (F.col("_s") >= LEAST_S)).drop("_n", "_s")


def indexed(voyages: DataFrame) -> DataFrame:
    return voyages.withColumn("idx", (F.row_number().over(by_voyage()) - 1).cast("int"))


def speed_edges(voyages: DataFrame) -> DataFrame:
    """Pairs of messages of a voyage, at most four apart, between which the speed is infeasible: (mmsi, voyage, a, b)."""
    rows = indexed(voyages).select("mmsi", "voyage", "idx", "ts_s", "seq", "lat", "lon")
    own = F.struct("idx", "ts_s", "lat", "lon")
    ahead = rows.withColumns({f"_{i}": F.lead(own, i).over(by_voyage()) for i in range(1, EDGE_REACH + 1)})
    pairs = ahead.withColumn("o", F.explode(F.array(*[f"_{i}" for i in range(1, EDGE_REACH + 1)]))).filter(F.col("o.ts_s") - F.col("ts_s") > EDGE_LEAST_S)
    flat = pairs.select("mmsi", "voyage", F.col("idx").alias("a"), F.col("o.idx").alias("b"), (F.col("o.ts_s") - F.col("ts_s")).alias("dt"), "lat", "lon", F.col("o.lat").alias("lat2"), F.col("o.lon").alias("lon2"))
    measured = with_inverse(flat, "lat", "lon", "lat2", "lon2", "d")
    # a plain filter on d would be pushed down through every step of the formula, doubling it each time
    fast = F.when(F.col("d") / F.col("dt") > SPEED_MAX * KNOT, F.array(F.struct("a", "b")))
    return measured.select("mmsi", "voyage", F.explode_outer(fast).alias("e")).filter("e is not null").select("mmsi", "voyage", "e.a", "e.b")


_BRACKET = ("ts_s", "lat", "lon", "sog", "cog", "heading", "rot", "nav_status")


def _with_ticks(rows: DataFrame) -> DataFrame:
    k = lambda c: F.ceil((F.col(c) - F.col("t0")) / F.lit(float(TICK_S)))
    return rows.withColumns({"k0": k("ts_s"), "k1": k("ts_s2") - 1}).filter("k1 >= k0")


def brackets(voyages: DataFrame) -> DataFrame:
    """Each message with its follower and the numbers ``k0`` to ``k1`` of the five-minute ticks from it on and before the follower.

    The ticks count from the voyage's first message.  A message without a tick is left out; of
    messages at one time only the last can have any.
    """
    w = Window.partitionBy("mmsi", "voyage")
    follower = [F.lead(x).over(by_voyage()).alias(f"{x}2") for x in _BRACKET]
    rows = voyages.select("*", F.min("ts_s").over(w).alias("t0"), F.max("ts_s").over(w).alias("tn"), *follower).filter("ts_s2 is not null")
    return _with_ticks(rows)


def long_brackets(messages: DataFrame) -> DataFrame:
    """``brackets`` of the long voyages of messages that no step has thinned, hour by hour; all are within the gap."""
    return _with_ticks(slots.with_followers(messages, _BRACKET))


def at_ticks(bracketed: DataFrame) -> DataFrame:
    """A row for each tick of each bracket."""
    return bracketed.withColumn("tick", F.explode(F.sequence("k0", "k1"))).withColumn("t", F.col("t0") + TICK_S * F.col("tick")).drop("k0", "k1")


def ticks(voyages: DataFrame) -> DataFrame:
    """Each message with its follower, once for every tick between them (end exclusive)."""
    return at_ticks(brackets(voyages))


def linear(ticked: DataFrame) -> DataFrame:
    """Speed, course, heading and rate of turn between the two messages, and the status of the nearer one (the earlier on a tie)."""
    share = (F.col("t") - F.col("ts_s")) / (F.col("ts_s2") - F.col("ts_s"))
    mid = {c: F.col(c) + (F.col(f"{c}2") - F.col(c)) * F.col("share") for c in ("sog", "cog", "heading", "rot")}
    nav = F.when(F.col("t") - F.col("ts_s") <= F.col("ts_s2") - F.col("t"), F.col("nav_status")).otherwise(F.col("nav_status2"))
    return ticked.withColumn("share", share).withColumns({**mid, "nav_status": nav})


def gap_facts(voyages: DataFrame) -> DataFrame:
    """The messages with ``_worst``, the longest bracket of their voyage (0 for a single message), and ``_first``, whether they begin it."""
    rows = voyages.withColumns({"_next": F.lead("ts_s").over(by_voyage()), "_first": F.lag("ts_s").over(by_voyage()).isNull()})
    worst = F.max(F.col("_next") - F.col("ts_s")).over(Window.partitionBy("mmsi", "voyage"))
    return rows.withColumn("_worst", F.coalesce(worst, F.lit(0))).drop("_next")


def sampled(voyages: DataFrame) -> DataFrame:
    """Voyages without a bracket over two hours: one with such a bracket is lost as a whole."""
    return gap_facts(voyages).filter(F.col("_worst") <= GAP_S).drop("_first", "_worst")


def resample(voyages: DataFrame) -> DataFrame:
    """A row for each tick, positions on the geodesic between the two messages around it."""
    return positions(brackets(sampled(voyages)))


def positions(bracketed: DataFrame) -> DataFrame:
    """A row for each tick of each bracket, with its position."""
    from driftline.functions.geodesic import with_direct

    # the geodesic of a bracket is found once, before its ticks are made
    rows = with_inverse(bracketed, "lat", "lon", "lat2", "lon2", "_d", "_az")
    rows = linear(at_ticks(rows)).withColumn("_part", F.col("_d") * F.col("share"))
    rows = with_direct(rows, "lat", "lon", "_az", "_part", "_lat", "_lon")
    same = F.col("_d") == 0
    return rows.select("mmsi", "voyage", "tick", "t", F.when(same, F.col("lat")).otherwise(F.col("_lat")).alias("lat"), F.when(same, F.col("lon")).otherwise(F.col("_lon")).alias("lon"), "sog", "cog", "heading", "rot", "nav_status")


def chunks(resampled: DataFrame) -> DataFrame:
    """Each tick's chunk of a day."""
    return resampled.withColumns({"chunk": F.floor(F.col("tick") / CHUNK_TICKS).cast("int"), "step": (F.col("tick") % CHUNK_TICKS).cast("int")})


def chunk_stats(chunked: DataFrame) -> DataFrame:
    """Chunks of four hours or more, numbered by vessel in order, and their share of slow ticks.

    The numbers count the chunks that are long enough, before slow ones go, so they can have holes.
    """
    found = chunked.groupBy("mmsi", "voyage", "chunk").agg(F.count(F.lit(1)).alias("n_ticks"), F.avg((F.col("sog") < SLOW_KNOTS).cast("int")).alias("slow_share"))
    w = Window.partitionBy("mmsi").orderBy("voyage", "chunk")
    return found.filter(F.col("n_ticks") >= LEAST_TICKS).withColumn("k", (F.row_number().over(w) - 1).cast("int"))


def final_steps(resampled: DataFrame) -> DataFrame:
    """Normalised steps of the chunks that stay: (mmsi, k, step, ...).

    The chunks are measured by windows under the partitioning by vessel, so ticks are made once
    and meet nothing; ``chunk_stats`` has the same rules.
    """
    w = Window.partitionBy("mmsi", "voyage", "chunk")
    measured = chunks(resampled).withColumns({"_n": F.count(F.lit(1)).over(w), "_slow": F.avg((F.col("sog") < SLOW_KNOTS).cast("int")).over(w)})
    numbered = measured.filter(F.col("_n") >= LEAST_TICKS).withColumn("k", (F.dense_rank().over(Window.partitionBy("mmsi").orderBy("voyage", "chunk")) - 1).cast("int"))
    return normalise(numbered.filter(F.col("_slow") <= SLOW_SHARE)).drop("voyage", "chunk", "_n", "_slow")


def processed(cleaned: DataFrame) -> DataFrame:
    """Final steps of cleaned messages, dealt by vessel once for all windows."""
    return final_steps(resample(cleaned.repartition("mmsi")))


def normalise(rows: DataFrame) -> DataFrame:
    from driftline.schema import COG_MAX, LAT_MAX, LAT_MIN, LON_MAX, LON_MIN

    return rows.withColumns(
        {
            "lat": (F.col("lat") - LAT_MIN) / (LAT_MAX - LAT_MIN),
            "lon": (F.col("lon") - LON_MIN) / (LON_MAX - LON_MIN),
            "sog": F.least(F.col("sog"), F.lit(SPEED_MAX)) / SPEED_MAX,
            "cog": F.col("cog") / COG_MAX,
        }
    )


def denormalise(rows: DataFrame) -> DataFrame:
    from driftline.schema import COG_MAX, LAT_MAX, LAT_MIN, LON_MAX, LON_MIN

    return rows.withColumns(
        {"lat": F.col("lat") * (LAT_MAX - LAT_MIN) + LAT_MIN, "lon": F.col("lon") * (LON_MAX - LON_MIN) + LON_MIN, "sog": F.col("sog") * SPEED_MAX, "cog": F.col("cog") * COG_MAX}
    )
