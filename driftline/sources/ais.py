"""Position reports: the CSV reader, the Parquet sinks, and a view of ``events`` in the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.codes import nav_status, ship_type
from driftline.schema import RAW


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily CSV files (``*.csv`` under a folder, or one path), named columns, one row for each report.

    Only the columns of the fixed schema are read, by header name; a value that isn't of its type
    is null.  A report whose time doesn't parse has a null ts_s and shows in ``quarantine``.
    ``seq`` keeps the order of rows within a file for equal times.
    """
    raw = spark.read.options(header=True, enforceSchema=False, pathGlobFilter="*.csv").csv(path)
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in RAW.fields]
    return named(raw.select(*typed, F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("seq")))


def named(raw: DataFrame) -> DataFrame:
    time = F.unix_timestamp(F.try_to_timestamp(F.col("# Timestamp"), F.lit("dd/MM/yyyy HH:mm:ss")))
    return raw.select(
        F.col("MMSI").alias("mmsi"),
        time.alias("ts_s"),
        "seq",
        F.col("Latitude").alias("lat"),
        F.col("Longitude").alias("lon"),
        F.col("SOG").alias("sog"),
        F.col("COG").alias("cog"),
        F.col("Heading").alias("heading"),
        F.col("ROT").alias("rot"),
        F.col("Navigational status").alias("nav_text"),
        F.col("Ship type").alias("ship_text"),
        "file_name",
        F.to_date(F.regexp_extract("file_name", r"(\d{4}-\d{1,2}-\d{1,2})", 1)).alias("file_date") if "file_name" in raw.columns else F.lit(None).cast("date").alias("file_date"),
    )


def quarantine(messages: DataFrame) -> DataFrame:
    """Rows that can't be used because their time doesn't parse."""
    return messages.filter("ts_s is null")


def write_daily(messages: DataFrame, path: str) -> None:
    messages.write.mode("overwrite").partitionBy("file_date").parquet(path)


def write_voyages(steps: DataFrame, path: str) -> None:
    """Final voyage steps, one folder for each split or day where the frame has such a column."""
    by = [c for c in ("split", "file_date") if c in steps.columns]
    (steps.write.mode("overwrite").partitionBy(*by) if by else steps.write.mode("overwrite")).parquet(path)


VIEW = """
with e as (select event_id, user_id, value, event_type, unix_seconds(cast(ts as timestamp)) - 1704067200 as s from {events}),
a as (select *, cast(floor(s / 20e0) as bigint) as q from e),
b as (select *, (q + user_id * 3571) % 86400 as p from a),
t as (select *, case when p < 43200 then p else 86400 - p end as tri from b)
select 219000000 + user_id as mmsi, 1704067200 + q as ts_s, event_id as seq,
  55e0 + 2e0 * tri / 43200e0 + case when event_id % 97 = 0 then 5e-1 else 0e0 end as lat,
  6e0 + (user_id % 10) + 5e-1 * tri / 43200e0 as lon,
  case when user_id % 7 = 0 then floor(value * 100e0 / 60e0) / 100e0 else floor(value * 100e0 / 8e0) / 100e0 end as sog,
  (event_id * 37 % 3600) / 10e0 as cog,
  case when event_id % 11 = 0 then null else event_id * 13 % 360 end as heading,
  case when event_id % 13 = 0 then null else (event_id * 7 % 41 - 20) / 1e0 end as rot,
  case event_type when 'click' then 'Under way using engine' when 'view' then 'Under way sailing' when 'signup' then 'Moored'
    when 'purchase' then 'Engaged in fishing' else 'no such status' end as nav_text,
  case user_id % 8 when 0 then 'Cargo' when 1 then 'Tanker' when 2 then 'Fishing' when 3 then 'Sailing' when 4 then 'Pleasure'
    when 5 then 'Passenger' when 6 then 'Tug' else (case when event_id % 3 = 0 then 'Cargo' else 'Undefined' end) end as ship_text,
  date_add(date '1970-01-01', cast(floor((1704067200 + q) / 86400e0) as int)) as file_date
from t
"""


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table in the shape of position reports, with codes."""
    return coded(spark.sql(VIEW, events=spark.read.parquet(f"{sf_dir}/events.parquet")))


def coded(messages: DataFrame) -> DataFrame:
    return messages.withColumns({"nav_status": nav_status("nav_text"), "vessel_type": ship_type("ship_text")})
