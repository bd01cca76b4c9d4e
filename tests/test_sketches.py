"""Sketches of days against exact counts and ranks, and unions against sketches of all rows."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from driftline.operators import sketches as K


def rows(spark):
    r = np.random.RandomState(6)
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=int(i))
    data = [(day(d), int(m), 55.0 + int(d), float(x), None if x > 2 else float(x)) for d, m, x in zip(r.randint(0, 10, 20_000), r.randint(0, 6000, 20_000), r.normal(0, 1, 20_000), strict=True)]
    data += [(day(3), None, float("nan"), None, 1.0), (day(40), 1, None, None, None)]
    return data, spark.createDataFrame(data, "file_date date, mmsi long, lat double, lon double, sog double")


def in_rank(values, got, share):
    return np.mean(values < got) <= share + K.RANK_ERROR and np.mean(values <= got) >= share - K.RANK_ERROR


def test_a_union_of_days_is_as_good_as_one_sketch(spark):
    data, frame = rows(spark)
    by_day = K.daily(frame)
    ask = lambda f: f.select(K.n_vessels().alias("n"), K.n_values("lons").alias("k"), K.quantile("lons", 0.25).alias("q"), K.quantile("sogs", 0.9).alias("s")).first()
    union, whole = ask(K.merged(by_day)), ask(K.merged(K.daily(frame.withColumn("file_date", F.lit(None).cast("date")))))
    exact = len({d[1] for d in data if d[1] is not None})
    lon, sog = (np.array([d[i] for d in data if d[i] is not None]) for i in (3, 4))
    for got in (union, whole):
        assert abs(got["n"] - exact) <= exact * K.COUNT_ERROR
        assert got["k"] == len(lon)
        assert in_rank(lon, got["q"], 0.25)
        assert in_rank(sog, got["s"], 0.9)
    # registers of a union are those of all rows
    assert union["n"] == whole["n"]
    # two levels: vessels' days, then days, then all
    vessel_days = K.daily(frame.withColumn("m", F.col("mmsi") % 3), "m")
    assert ask(K.merged(K.merged(vessel_days, "file_date")))["n"] == union["n"]


def test_rolling_days(spark):
    data, frame = rows(spark)
    got = {r["file_date"]: (r["n"], r["k"], r["q"]) for r in K.rolling(K.daily(frame), 4).select("file_date", K.n_vessels().alias("n"), K.n_values("lons").alias("k"), K.quantile("lons", 0.5).alias("q")).collect()}
    assert set(got) == {d[0] for d in data}
    for last, (n, k, q) in got.items():
        own = [d for d in data if 0 <= (last - d[0]).days < 4]
        exact, lon = len({d[1] for d in own if d[1] is not None}), np.array([d[3] for d in own if d[3] is not None])
        assert k == len(lon)
        assert abs(n - exact) <= max(1, exact * K.COUNT_ERROR)
        assert q is None if not len(lon) else in_rank(lon, q, 0.5)


def test_no_rows(spark):
    none = rows(spark)[1].limit(0)
    assert K.daily(none).count() == 0
    assert K.rolling(K.daily(none), 3).count() == 0
