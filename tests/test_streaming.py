from tables import TESTDATA

from driftline.operators import voyages
from driftline.plans import catalog
from driftline.streaming.voyages import voyage_sessions


def test_sessions_are_the_voyages(spark):
    rows = catalog.messages(spark, f"{TESTDATA}/sf0.001")
    want = voyages.stats(voyages.split(rows)).select("mmsi", "t0", "tn", "n").collect()
    assert sorted(voyage_sessions(rows).collect()) == sorted(want)


def test_a_stream_gives_the_same_sessions(spark, tmp_path):
    rows = catalog.messages(spark, f"{TESTDATA}/sf0.001").select("mmsi", "ts_s")
    rows.write.parquet(str(tmp_path / "in"))
    stream = voyage_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    running = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    running.awaitTermination(60)
    assert sorted(spark.table("sessions").collect()) == sorted(voyage_sessions(rows).collect())
