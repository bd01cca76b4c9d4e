"""Trajectory features, the dataset view, and sequence preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geodesic import with_inverse
from driftline.functions.hashing import portable
from driftline.schema import CAP, CLS, IGNORED, SEP, UNKNOWN_NAV

KEYS = ("mmsi", "voyage")
#: Letters of a file name that make a range; a vessel's number has nine, so a range has at most a thousand vessels.
BEGINNING = 6
#: Batches whose longest sequence is sent to every executor.
MOST_BATCHES = 1_000_000


def _measures() -> list[Column]:
    start = F.timestamp_seconds(F.min("ts_s"))
    return [
        F.avg("sog").alias("speed_avg"),
        F.max("sog").alias("speed_max"),
        F.stddev_pop("sog").alias("speed_std"),
        F.coalesce(F.expr(f"mode() within group (order by case when nav_status <> {UNKNOWN_NAV} then nav_status end)"), F.lit(UNKNOWN_NAV)).alias("nav_status"),
        (F.max("ts_s") - F.min("ts_s")).cast("double").alias("duration"),
        F.hour(start).alias("hour_start"),
        F.month(start).alias("month"),
        F.max("lat").alias("lat_max"),
        F.min("lat").alias("lat_min"),
        F.max("lon").alias("lon_max"),
        F.min("lon").alias("lon_min"),
        F.avg("lat").alias("lat_mean"),
        F.avg("lon").alias("lon_mean"),
        F.median("lat").alias("lat_median"),
        F.median("lon").alias("lon_median"),
        F.stddev_pop("cog").alias("cog_std"),
    ]


def speed_and_status(rows: DataFrame) -> DataFrame:
    """One row for each trajectory: speeds, status, times, positions and course spread."""
    return rows.groupBy(*KEYS).agg(*_measures())


def displacement(rows: DataFrame) -> DataFrame:
    """Metres from the first to the last position."""
    at = F.struct("ts_s", "seq")
    ends = rows.groupBy(*KEYS).agg(*[f(c, at).alias(f"{c}{n}") for n, f in ((1, F.min_by), (2, F.max_by)) for c in ("lat", "lon")])
    return with_inverse(ends, "lat1", "lon1", "lat2", "lon2", "displacement").select(*KEYS, "displacement")


def legs(rows: DataFrame) -> DataFrame:
    """``rows`` with the metres ``_leg`` to the follower; from the last position back to the first, and ``_last`` is true there."""
    w = Window.partitionBy(*KEYS).orderBy("ts_s", "seq")
    last = F.lead(F.lit(1)).over(w).isNull()
    ahead = rows.withColumns({"_last": last, **{f"_{c}2": F.when(last, F.first(c).over(w)).otherwise(F.lead(c).over(w)) for c in ("lat", "lon")}})
    return with_inverse(ahead, "lat", "lon", "_lat2", "_lon2", "_leg").drop("_lat2", "_lon2")


def _lengths() -> list[Column]:
    """Metres along the positions, and from the first to the last, from rows with legs."""
    along = F.coalesce(F.sum(F.when(~F.col("_last"), F.col("_leg"))), F.lit(0.0))
    return [along.alias("length"), F.max(F.when(F.col("_last"), F.col("_leg"))).alias("displacement")]


def _with_ratio(lengths: DataFrame) -> DataFrame:
    return lengths.withColumn("length_over_displacement", F.when(F.col("displacement") > 0, F.col("length") / F.nullif(F.col("displacement"), F.lit(0.0))).otherwise(1.0))


def path_length(rows: DataFrame) -> DataFrame:
    """Metres along the positions and from the first to the last, and their ratio (1 where the latter is 0)."""
    return _with_ratio(legs(rows.select(*KEYS, "ts_s", "seq", "lat", "lon")).groupBy(*KEYS).agg(*_lengths()))


def features(rows: DataFrame) -> DataFrame:
    """All features, in one pass over one partitioning."""
    used = rows.select(*KEYS, "ts_s", "seq", "lat", "lon", "sog", "cog", "nav_status")
    return _with_ratio(legs(used).groupBy(*KEYS).agg(*_measures(), *_lengths()))


def capped(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.when(F.col(c) > CAP, F.lit(CAP)).otherwise(F.col(c)) for c in ("lat", "lon", "sog", "cog")})


def sample_index(trajectories: DataFrame) -> DataFrame:
    """The place of each (mmsi, k) in the string order of its file name; k = 10 comes before k = 2.

    The order is global: places are counted among names with the same beginning, and shifted by
    the names with beginnings before.
    """
    named = trajectories.select("mmsi", "k", F.concat_ws("_", "mmsi", "k", F.lit("processed.pkl")).alias("file_name")).withColumn("_begin", F.substring("file_name", 1, BEGINNING))
    within = F.row_number().over(Window.partitionBy("_begin").orderBy("file_name"))
    placed = shifted(named.withColumn("_at", within), named, "_begin", F.count(F.lit(1)))
    return placed.select("mmsi", "k", "file_name", (F.col("_at") + F.col("_before") - 1).cast("long").alias("sample_idx"))


def shifted(rows: DataFrame, counted: DataFrame, group: str, size: Column) -> DataFrame:
    """``rows`` with ``_before``: the sizes of all groups before its own."""
    sizes = counted.groupBy(group).agg(size.alias("_n"))
    # one row for each beginning, hash prefix or length: two columns, joined as their size asks for
    before = sizes.select(group, F.coalesce(F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, group)


def sample_items(steps: DataFrame) -> DataFrame:
    """One row for each trajectory: capped features in order, length, vessel, start time."""
    row = F.struct("ts_s", "seq", F.array(*[F.col(c).cast("float") for c in ("lat", "lon", "sog", "cog")]).alias("x"))
    return (
        capped(steps)
        .groupBy(*KEYS)
        .agg(F.sort_array(F.collect_list(row)).alias("_rows"))
        .select(F.col("mmsi").cast("int").alias("mmsi"), "voyage", F.transform("_rows", lambda r: r["x"]).alias("features"), F.size("_rows").alias("seqlen"), F.get("_rows", F.lit(0))["ts_s"].cast("int").alias("time_start"))
    )


def sample_lookup(items: DataFrame, mmsi: int, time_start: int) -> DataFrame:
    """The sample of a vessel with a start time; raises ``KeyError`` where there is none."""
    found = items.filter((F.col("mmsi") == mmsi) & (F.col("time_start") == time_start)).limit(1)
    if found.isEmpty():
        raise KeyError(f"vessel {mmsi} has no trajectory that starts at {time_start}")
    return found


def token_sequences(items: DataFrame, max_len: int, cls_sep: bool = True) -> DataFrame:
    """``tokens``: the sequence cut to the room that is left, between a row of -1 and a row of -2 (or none of these)."""
    room = max_len - 2 if cls_sep else max_len
    body = F.slice("features", 1, room)
    row = lambda v: F.array(F.array_repeat(F.lit(v).cast("float"), 4))
    tokens = F.concat(row(CLS), body, row(SEP)) if cls_sep else body
    return items.withColumn("tokens", tokens)


def padded(items: DataFrame, batch: str) -> DataFrame:
    """``input_features`` padded with rows of 0 to the batch's longest, and the attention mask."""
    longest = items.groupBy(batch).agg(F.max(F.size("tokens")).alias("_long"))
    # two numbers for each batch; sequences aren't moved where these fit every executor
    wide = items.join(F.broadcast(longest) if longest.count() <= MOST_BATCHES else longest, batch)
    missing = F.col("_long") - F.size("tokens")
    zero = F.array_repeat(F.lit(0.0).cast("float"), 4)
    return wide.withColumns(
        {"input_features": F.concat("tokens", F.array_repeat(zero, missing)), "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size("tokens")), F.array_repeat(F.lit(0), missing))}
    ).drop("_long")


def masked_tokens(items: DataFrame, per_hundred: int = 15, seed: int = 42) -> DataFrame:
    """Chosen tokens become rows of 0 and keep their values as labels; all other labels are -100.

    The choice is a fixed rule of vessel, voyage and place, so it can be repeated; the first and
    last tokens are never chosen.
    """
    n = F.size("tokens")
    chosen = lambda i: (i > 0) & (i < n - 1) & ((F.col("mmsi") * 7919 + F.col("voyage") * 104729 + i * 31 + seed) % 100 < per_hundred)
    fill = lambda v: F.array_repeat(F.lit(v).cast("float"), 4)
    return items.withColumns(
        {
            "masked": F.transform("tokens", lambda x, i: F.when(chosen(i), fill(0.0)).otherwise(x)),
            "labels": F.transform("tokens", lambda x, i: F.when(chosen(i), x).otherwise(fill(IGNORED))),
        }
    )


def split_vessels(trajectories: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """train, val or test for every vessel as a whole: vessels in hash order fill train, then val, then test.

    A part takes vessels until its size is reached, and may overshoot; the next part counts anew.
    Running sums are made among vessels whose hashes begin alike, and shifted by those before.
    """
    vessels = trajectories.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.min(portable("mmsi", "k", seed=seed)).alias("o")).withColumn("_begin", F.substring("o", 1, 4))
    facts = vessels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_test, n_val = int(facts["n"] * test), int(facts["n"] * val)
    n_train = facts["n"] - n_test - n_val
    within = F.sum("n").over(Window.partitionBy("_begin").orderBy("o", "mmsi")) - F.col("n")
    run = shifted(vessels.withColumn("_within", within), vessels, "_begin", F.sum("n")).select("mmsi", "n", (F.col("_within") + F.col("_before")).alias("before"))
    first = run.filter(F.col("before") >= n_train).agg(F.min("before")).first()[0]
    in_val = F.lit(False) if first is None else F.col("before") - first < n_val
    return run.select("mmsi", "n", F.when(F.col("before") < n_train, "train").when(in_val, "val").otherwise("test").alias("split"))
