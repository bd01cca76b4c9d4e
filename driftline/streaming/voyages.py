"""An extension: voyages of a stream of reports as session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.schema import GAP_S


def voyage_sessions(messages: DataFrame, lateness: str = "30 minutes") -> DataFrame:
    """(mmsi, t0, tn, n) of each vessel's sessions, closed once the watermark has passed the gap.

    ``messages`` has mmsi and ts_s, streaming or not.  A session ends two hours after its last
    report; a report later than the watermark allows is dropped, as in any windowed aggregation.
    """
    timed = messages.withColumn("ts", F.timestamp_seconds("ts_s"))
    timed = timed.withWatermark("ts", lateness) if messages.isStreaming else timed
    # one microsecond more keeps a gap of exactly two hours in one voyage
    window = F.session_window("ts", f"{GAP_S} seconds 1 microsecond")
    return timed.groupBy("mmsi", window).agg(F.min("ts_s").alias("t0"), F.max("ts_s").alias("tn"), F.count(F.lit(1)).alias("n")).select("mmsi", "t0", "tn", "n")
