"""Days added one by one, late and again, against all days at once."""

import os

import pytest
from tables import TESTDATA

from driftline.operators import ingest, slots
from driftline.sources import ais
from driftline.sources.store import VesselStore, final_steps

TABLES = ("messages", "hours", "voyages", "types", "reduced")


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    """Reports of several days, as sparse vessels need for voyages: each event's time is stretched over its vessel's own days."""
    at = str(tmp_path_factory.mktemp("reports") / "r")
    ais.from_events(spark, f"{TESTDATA}/sf0.001").write.parquet(at)
    return spark.read.parquet(at)


def files(home, name):
    return {(os.path.relpath(d, f"{home}/{name}"), f) for d, _, fs in os.walk(f"{home}/{name}") for f in fs if f.endswith(".parquet")}


def rows(store, name):
    got = store.table(name)
    names = sorted(c for c in got.columns)
    return sorted((tuple(str(r[c]) if not isinstance(r[c], float) else f"{r[c]:.9g}" for c in names) for r in got.collect()))


def days_of(reports):
    return sorted(r[0] for r in reports.select("file_date").distinct().collect())


def test_day_by_day_equals_all_at_once(spark, reports, tmp_path):
    days = days_of(reports)
    assert len(days) >= 2
    whole, stepwise = VesselStore(spark, str(tmp_path / "whole"), 4), VesselStore(spark, str(tmp_path / "steps"), 4)
    whole.add(reports)
    # the last day first: late days count as well
    for day in [days[-1], *days[:-1]]:
        stepwise.add(reports.filter(reports.file_date == day))
    stepwise.add(reports.filter(reports.file_date == days[0]))
    for name in TABLES:
        assert rows(stepwise, name) == rows(whole, name), name
    kept = ingest.in_range(reports, own_day=True)
    want = sorted(map(tuple, slots.stats(kept).collect()))
    assert sorted(tuple(r) for r in whole.table("voyages").select("mmsi", "voyage", "n", "t0", "tn").collect()) == want
    assert final_steps(slots.placed(kept, "voyage", only_long=True).drop("_slot")).count() == whole.table("reduced").count() > 0


def test_only_the_buckets_of_a_days_vessels_are_written(spark, reports, tmp_path):
    store = VesselStore(spark, str(tmp_path / "s"), 8)
    store.add(reports, None)
    before = {n: files(store.home, n) for n in ("messages", "hours", "voyages", "types")}
    one = reports.first()
    alone = reports.filter((reports.file_date == days_of(reports)[0]) & (reports.mmsi == one.mmsi))
    late = alone.selectExpr("* except (ts_s, file_date)", "ts_s + 86400 * 30 as ts_s", "date_add(file_date, 30) as file_date")
    touched = store.add(late, None)
    assert len(touched) == 1
    for name, was in before.items():
        now = files(store.home, name)
        other = {f for f in was if f"bucket={touched[0]}" not in f[0].split("/")}
        assert len(other) > 3
        assert other <= now
        assert {f for f in now - was} and all(f"bucket={touched[0]}" in d.split("/") for d, _ in now - was)


def test_a_day_delivered_again_replaces_itself(spark, reports, tmp_path):
    store, want = VesselStore(spark, str(tmp_path / "s"), 4), VesselStore(spark, str(tmp_path / "w"), 4)
    day = days_of(reports)[0]
    first = reports.filter(reports.file_date == day)
    vessels = [r[0] for r in first.select("mmsi").distinct().orderBy("mmsi").limit(2).collect()]
    store.add(reports, None)
    store.add(first.filter(first.mmsi.isin(vessels)), None)
    want.add(reports.filter((reports.file_date != day) | reports.mmsi.isin(vessels)), None)
    for name in ("messages", "hours", "voyages", "types_daily"):
        assert rows(store, name) == rows(want, name), name


def test_a_reduce_function_of_the_callers(spark, reports, tmp_path):
    store = VesselStore(spark, str(tmp_path / "s"), 4)
    store.add(reports, lambda long: long.groupBy("mmsi", "voyage").count())
    got = {(r["mmsi"], r["voyage"]): r["count"] for r in store.table("reduced").collect()}
    assert got == {(r["mmsi"], r["voyage"]): r["n"] for r in slots.stats(ingest.in_range(reports, own_day=True), only_long=True).collect()}
