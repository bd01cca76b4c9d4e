"""Ingest rules: range filter, per-day vessel types, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.schema import COG_MAX, LAT_MAX, LAT_MIN, LON_MAX, LON_MIN, SPEED_MAX


def within() -> Column:
    """Whether a report is in the bounds, all inclusive."""
    return F.col("lat").between(LAT_MIN, LAT_MAX) & F.col("lon").between(LON_MIN, LON_MAX) & F.col("sog").between(0.0, SPEED_MAX) & F.col("cog").between(0.0, COG_MAX)


def in_range(messages: DataFrame, own_day: bool = False) -> DataFrame:
    """Reports within the bounds, all inclusive; a null in a tested column, or no time, drops the row.

    With ``own_day``, also only those whose time lies in the day of their file, in UTC.
    """
    kept = messages.filter(within())
    if "ts_s" in kept.columns:
        kept = kept.filter("ts_s is not null")
    if own_day:
        start = F.unix_timestamp(F.col("file_date").cast("timestamp"))
        kept = kept.filter((F.col("ts_s") >= start) & (F.col("ts_s") < start + 86400))
    return kept


def vessel_type_daily(messages: DataFrame) -> DataFrame:
    """The most frequent defined ship type of each vessel and day; the smallest code on ties."""
    return messages.filter("vessel_type <> 0").groupBy("file_date", "mmsi").agg(F.expr("mode() within group (order by vessel_type)").alias("vessel_type"))


def vessel_type_combined(daily: DataFrame) -> DataFrame:
    """One type for each vessel: the latest day's."""
    return daily.groupBy("mmsi").agg(F.max_by("vessel_type", "file_date").alias("vessel_type"))


def ingest_stats(messages: DataFrame) -> DataFrame:
    """Rows, rows in range and vessels by day; vessels with a defined type apart."""
    ok = within()
    return messages.groupBy("file_date").agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count(F.when(ok, 1)).alias("n_in_range"),
        F.count_distinct("mmsi").alias("n_vessels"),
        F.count_distinct(F.when(F.col("vessel_type") != 0, F.col("mmsi"))).alias("n_typed_vessels"),
    )
