"""A store of vessels that takes days as they arrive, in any order, and works on nothing else again.

A vessel belongs to one of a fixed number of buckets.  Three kinds of table lie under the store:

- what a day brings, by bucket and day: its messages, its vessels' hours (``operators.slots``) and types;
- what follows for vessels, by bucket: voyages, types, and what a reduce function makes of long voyages;
- the days that have been added.

A day writes its own folders of the first kind.  Hours carry all that voyages of other days need,
so voyages are folded anew from the hours of the buckets that the day has touched, and messages are
read again only for the reduce function, of these buckets alone.  Spark's dynamic partition
overwrite replaces these buckets' folders; files of all others stay.  A day that is added again
replaces itself.  A run that broke off is repeated by adding its days again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import ingest, outliers, slots, voyages

#: Makes rows with a column mmsi from the messages of long voyages (mmsi, voyage, ...) of some vessels.
Reduce = Callable[[DataFrame], DataFrame]


def final_steps(long: DataFrame) -> DataFrame:
    """The usual reduce function: outliers go, and normalised steps of the rest."""
    return voyages.processed(outliers.clean(long))


@dataclass
class VesselStore:
    """Tables under ``home``; ``buckets`` must stay what they were when the first day was added."""

    spark: SparkSession
    home: str
    buckets: int = 256

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("mmsi"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, name: str, *by: str) -> None:
        # a bucket's rows meet in few tasks, and as many files, but a large one is not gathered in one
        rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.home}/{name}")

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """``messages``, ``hours``, ``types_daily``, ``voyages``, ``types`` or ``reduced``, whole or of some buckets."""
        rows = self.spark.read.parquet(f"{self.home}/{name}")
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def _forget(self, name: str, days: list[str], keep: set[tuple[int, str]]) -> set[int]:
        """Remove folders of these days that their new delivery hasn't written; the buckets that lost one."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        lost = set()
        for day in days:
            for found in files.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}/bucket=*/file_date={day}")) or []:
                bucket = int(found.getPath().getParent().getName().partition("=")[2])
                if (bucket, day) not in keep:
                    files.delete(found.getPath(), True)
                    lost.add(bucket)
        return lost

    def add(self, messages: DataFrame, reduce: Reduce | None = final_steps) -> list[int]:
        """Add the days of ``messages`` (coded reports with file_date); returns the buckets that were worked on.

        Reports out of range, without a vessel or outside of their own day go.  A day is delivered
        whole: its rows replace any that it had before.  Without a reduce function no message is
        read again.
        """
        kept = ingest.in_range(messages, own_day=True).filter("mmsi is not null").withColumn("bucket", self._bucket())
        days = [str(r[0]) for r in messages.select("file_date").distinct().filter("file_date is not null").collect()]
        self._write(kept, "messages", "bucket", "file_date")
        new = self.table("messages").filter(F.col("file_date").isin(days))
        # one pair for each bucket and day that has been written
        hours = slots.slots(new).select("*", F.to_date(F.timestamp_seconds(F.col("slot") * slots.SLOT_S)).alias("file_date"), self._bucket())
        self._write(hours, "hours", "bucket", "file_date")
        self._write(ingest.vessel_type_daily(new).withColumn("bucket", self._bucket()), "types_daily", "bucket", "file_date")
        written = {(r[0], str(r[1])) for r in kept.select("bucket", "file_date").distinct().collect()}
        lost = set().union(*(self._forget(name, days, written) for name in ("messages", "hours", "types_daily")))
        touched = sorted({b for b, _ in written} | lost)
        self.refresh(touched, reduce)
        return touched

    def refresh(self, touched: list[int], reduce: Reduce | None = final_steps) -> None:
        """Voyages, types and reduced rows of these buckets, from what their days have brought."""
        hours = slots.folded(self.table("hours", touched))
        made = {
            "voyages": hours.filter("back is null").select("mmsi", "voyage", F.col("n_voyage").alias("n"), "t0", "tn"),
            "types": ingest.vessel_type_combined(self.table("types_daily", touched)),
        }
        if reduce is not None:
            long = slots.joined(self.table("messages", touched), hours.filter(slots.is_long()), "voyage").drop("_slot", "bucket")
            made["reduced"] = reduce(long)
        for name, rows in made.items():
            self._write(rows.withColumn("bucket", self._bucket()), name, "bucket")
