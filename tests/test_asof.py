"""The as-of join against a scan, with hot keys, ties, nulls and slots of all widths."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from driftline.operators.asof import asof_join


def tables(seed):
    r = random.Random(seed)
    key = lambda: r.choice(["hot"] * 5 + ["a", "b", "c", None])
    time = lambda: None if r.random() < 0.05 else r.randint(-300, 300)
    left = [(key(), time(), i, r.choice([None, "x"])) for i in range(400)]
    right = [(key(), time(), i % 7, None if r.random() < 0.2 else i) for i in range(300)]
    return left + left[:5], right


@pytest.mark.parametrize(("slot", "strict", "tolerance", "how"), [(1, False, None, "left"), (50, True, None, "left"), (3600, False, 20, "inner"), (0.5, True, 7, "left")])
def test_equals_a_scan(spark, slot, strict, tolerance, how):
    left, right = tables(slot)
    want = []
    for k, t, i, x in left:
        fits = [] if k is None or t is None else [(rt, tie, v) for rk, rt, tie, v in right if rk == k and rt is not None and (rt < t if strict else rt <= t)]
        best = max(fits, key=lambda f: (f[0], f[1], f[2] is not None, f[2] or 0), default=None)
        best = best if best and (tolerance is None or t - best[0] <= tolerance) else None
        if best or how == "left":
            want.append((k, t, i, x, *(best or (None, None, None))))
    a = spark.createDataFrame(left, "k string, t int, i int, v string").repartition(3)
    b = spark.createDataFrame(right, "k string, t int, tie int, v int").repartition(4)
    got = asof_join(a, b, "k", "t", ["tie", "v"], how, strict, tolerance, slot)
    assert got.columns == ["k", "t", "i", "v", "t_right", "tie", "v_right"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_tables_and_two_keys(spark):
    a = spark.createDataFrame([(1, 2, 10, "p")], "k long, m long, t long, _time string")
    none = spark.createDataFrame([], "k long, m long, t long, _row string")
    assert [tuple(r) for r in asof_join(a, none, ["k", "m"], "t").collect()] == [(1, 2, 10, "p", None, None)]
    assert asof_join(none, a, ["k", "m"], "t").count() == 0
    other = spark.createDataFrame([(1, 3, 9, "n"), (1, 2, 9, "y")], "k long, m long, t long, _row string")
    assert [r["_row"] for r in asof_join(a, other, ["k", "m"], "t").collect()] == ["y"]
    with pytest.raises(ValueError, match="how"):
        asof_join(a, other, "k", "t", how="outer")


def test_a_hot_key_is_spread_and_no_range_is_joined(spark):
    rows = spark.range(0, 40_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 97).alias("k"), (F.col("id") * 9).alias("t"), "id")
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(was, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        made = asof_join(rows.filter("id % 3 = 0"), rows.filter("id % 3 <> 0"), "k", "t", "id")
        plan = made._jdf.queryExecution().executedPlan().toString()
        counts = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert not any(x in plan for x in ("NestedLoop", "Cartesian"))
    assert sum(counts) == 13_334
    assert max(counts) < 2 * median(counts)
