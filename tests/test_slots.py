"""Voyages by hours against a plain scan of each vessel, and how evenly a hot vessel is spread."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from driftline.operators import slots, voyages

COLUMNS = "mmsi long, ts_s long, seq long, lat double, lon double, sog double, cog double, heading double, rot double, nav_status int"


def plain(rows):
    """{(mmsi, seq): (gap, voyage, idx, follower's seq)} by one scan of each vessel."""
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for mmsi, own in by.items():
        own.sort(key=lambda r: (r[1], r[2]))
        last, voyage, idx = None, 0, 0
        for i, r in enumerate(own):
            gap = None if last is None else r[1] - last
            voyage, idx = (voyage + 1, 0) if gap is not None and gap > 7200 else (voyage, idx)
            after = own[i + 1] if i + 1 < len(own) and own[i + 1][1] - r[1] <= 7200 else None
            out[mmsi, r[2]] = (gap, voyage, idx, after and after[2])
            last, idx = r[1], idx + 1
    return out


def messages(seed, n=3000):
    r = random.Random(seed)
    rows, clock = [], {}
    for i in range(n):
        m = r.choice([1, 1, 1, 1, 2, 3, None])
        clock[m] = clock.get(m, r.choice([-9000, 0, 3599])) + r.choice([0, 0, 1, 59, 600, 3599, 3600, 3601, 7199, 7200, 7201, 20000] if r.random() < 0.2 else [0, 5, 60, 240])
        rows.append((m, clock[m], i, 55.0 + i % 7, 10.0, 5.0, 1.0, None, 0.0, 0))
    return rows


@pytest.mark.parametrize("slot_s", [1, 700, 3600, 7201])
def test_hours_give_what_a_scan_gives(spark, slot_s):
    rows = messages(slot_s)
    want, frame = plain(rows), spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = {(r["mmsi"], r["seq"]): (r["gap_s"], r["voyage"]) for r in slots.with_gaps(frame, slot_s).collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    sizes = {}
    times = {(r[0], r[2]): r[1] for r in rows}
    for k, (_, voyage, _, _) in want.items():
        sizes.setdefault((k[0], voyage), []).append(times[k])
    stat = {(r["mmsi"], r["voyage"]): (r["n"], r["t0"], r["tn"]) for r in slots.stats(frame, slot_s=slot_s).collect()}
    assert stat == {k: (len(v), min(v), max(v)) for k, v in sizes.items()}
    long = {k for k, v in sizes.items() if len(v) >= 20 and max(v) - min(v) >= 14400}
    assert long
    idx = {(r["mmsi"], r["seq"]): r["idx"] for r in slots.indexed(frame, slot_s).collect()}
    assert idx == {k: v[2] for k, v in want.items() if (k[0], v[1]) in long}
    after = {(r["mmsi"], r["seq"]): r["seq2"] for r in slots.with_followers(frame, ("ts_s", "seq"), slot_s).collect()}
    assert after == {k: v[3] for k, v in want.items() if (k[0], v[1]) in long and v[3] is not None}


def test_a_slot_is_no_longer_than_a_gap():
    with pytest.raises(ValueError, match="slot"):
        slots.slot(7202)


def test_no_messages_have_no_voyages(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert slots.stats(none).count() == 0
    assert voyages.positions(voyages.long_brackets(none)).count() == 0


@pytest.mark.parametrize("rule", ["gaps", "long", "ticks"])
def test_a_number_on_half_of_all_messages_is_spread(spark, rule):
    """With joins by sort, no task of the last stage has twice the messages of the median one."""
    near = spark.range(0, 60_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(100 + F.col("id") % 211).alias("mmsi"), (F.col("id") * 7).alias("ts_s"), F.col("id").alias("seq"))
    rows = near.selectExpr("*", "55e0 as lat", "10e0 as lon", "5e0 as sog", "1e0 as cog", "0e0 as heading", "0e0 as rot", "0 as nav_status")
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(was, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        made = {"gaps": lambda: voyages.split(rows), "long": lambda: voyages.long_messages(rows), "ticks": lambda: slots.with_followers(rows, ("ts_s",))}[rule]()
        counts = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sum(counts) > 59_000
    assert len(counts) == 8
    assert max(counts) < 2 * median(counts)
