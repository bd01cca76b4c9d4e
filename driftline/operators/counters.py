"""Counters of the stages from reports to final voyages: observed in the run that makes them, or found apart in two passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from driftline.schema import CHUNK_TICKS, GAP_S, LEAST_ROWS, LEAST_S, LEAST_TICKS, SLOW_KNOTS, SLOW_SHARE, SPEED_MAX, TICK_S

from . import slots, voyages
from .ingest import in_range, within
from .outliers import Choice, candidates, greedy, marked


def of_reports(raw: DataFrame) -> DataFrame:
    """One row: segments (days of a vessel), messages in range, discarded ones, voyages, and voyages that are long enough."""
    rows = raw.withColumn("ok", F.coalesce(within() & F.col("ts_s").isNotNull(), F.lit(False)))
    order = Window.partitionBy("mmsi", "ok").orderBy("ts_s", "seq")
    split = rows.withColumn("cut", F.when(F.col("ts_s") - F.lag("ts_s").over(order) > GAP_S, 1).otherwise(0))
    split = split.withColumn("voyage", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    voyages = split.groupBy("mmsi", "ok", "voyage").agg(F.count(F.lit(1)).alias("n"), (F.max("ts_s") - F.min("ts_s")).alias("s"), F.collect_set("file_date").alias("days"))
    vessels = voyages.groupBy("mmsi").agg(
        F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).alias("lost"),
        F.count(F.when(F.col("ok"), 1)).alias("voyages"),
        F.count(F.when(F.col("ok") & (F.col("n") >= LEAST_ROWS) & (F.col("s") >= LEAST_S), 1)).alias("long"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("ok"), F.col("days")))))).alias("segments"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return vessels.agg(
        total("segments").alias("num_segments"),
        total("kept").alias("num_messages"),
        total("lost").alias("num_discarded_filtered"),
        total("voyages").alias("num_initial_voyages"),
        total("long").alias("num_voyages_after_duration_filter"),
    )


def of_voyages(long_voyages: DataFrame) -> DataFrame:
    """One row: what outlier removal, sampling and chunking leave of the messages of long voyages.

    Each message gives a row for each of its ticks, or one row without a tick, so messages, ticks
    and chunks are counted in the same aggregation.  A voyage that loses all messages is an
    outlier removal error; one with a bracket over two hours is a sampling error.
    """
    rows = marked(long_voyages).select("mmsi", "voyage", "ts_s", "seq", "sog", "outlier").repartition("mmsi")
    group = Window.partitionBy("mmsi", "voyage", "outlier")
    order = group.orderBy("ts_s", "seq")
    rows = rows.withColumns({"ts2": F.lead("ts_s").over(order), "sog2": F.lead("sog").over(order), "t0": F.min("ts_s").over(group)})
    rows = rows.withColumn("worst", F.coalesce(F.max(F.col("ts2") - F.col("ts_s")).over(group), F.lit(0)))
    k = lambda c: F.ceil((F.col(c) - F.col("t0")) / F.lit(float(TICK_S)))
    has = ~F.col("outlier") & (F.col("worst") <= GAP_S) & (k("ts2") - 1 >= k("ts_s"))
    ticked = rows.withColumn("first", k("ts_s")).withColumn("tick", F.explode_outer(F.when(has, F.sequence(k("ts_s"), k("ts2") - 1))))
    share = (F.col("t0") + TICK_S * F.col("tick") - F.col("ts_s")) / (F.col("ts2") - F.col("ts_s"))
    ticked = ticked.withColumns({"speed": F.col("sog") + (F.col("sog2") - F.col("sog")) * share, "chunk": F.floor(F.col("tick") / CHUNK_TICKS), "one": F.col("tick").isNull() | (F.col("tick") == F.col("first"))})
    chunks = ticked.groupBy("mmsi", "voyage", "outlier", "chunk").agg(
        F.count(F.when(F.col("one"), 1)).alias("messages"), F.count("tick").alias("ticks"), F.avg((F.col("speed") < SLOW_KNOTS).cast("int")).alias("slow"), F.max("worst").alias("worst")
    )
    final = (F.col("ticks") >= LEAST_TICKS) & (F.col("slow") <= SLOW_SHARE)
    voyages = chunks.groupBy("mmsi", "voyage").agg(
        F.sum(F.when(F.col("outlier"), F.col("messages")).otherwise(0)).alias("removed"),
        F.sum(F.when(~F.col("outlier"), F.col("messages")).otherwise(0)).alias("kept"),
        F.max(F.when(~F.col("outlier"), F.col("worst"))).alias("worst"),
        F.sum("ticks").alias("ticks"),
        F.count(F.when(final, 1)).alias("final"),
        F.sum(F.when(final, F.col("ticks")).otherwise(0)).alias("final_rows"),
    )
    fine = (F.col("kept") > 0) & (F.col("worst") <= GAP_S)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return voyages.agg(
        total("removed").alias("num_messages_removed"),
        F.count(F.when(F.col("kept") > 0, 1)).alias("num_voyages_after_outlier_removal"),
        F.count(F.when(F.col("kept") == 0, 1)).alias("num_outlier_removal_errors"),
        F.count(F.when(fine, 1)).alias("num_voyages_after_sampling"),
        F.count(F.when((F.col("kept") > 0) & (F.col("worst") > GAP_S), 1)).alias("num_sampling_errors"),
        total("ticks").alias("num_resampled_rows"),
        total("final").alias("num_final_voyages"),
        total("final_rows").alias("num_final_rows"),
    )


def stacked(wide: DataFrame) -> DataFrame:
    """(counter, value) from one row of counters."""
    return wide.selectExpr(f"stack({len(wide.columns)}, {', '.join(f"'{c}', {c}" for c in wide.columns)}) as (counter, value)")


NAMES = (
    "num_segments",
    "num_messages",
    "num_discarded_filtered",
    "num_initial_voyages",
    "num_voyages_after_duration_filter",
    "num_messages_removed",
    "num_voyages_after_outlier_removal",
    "num_outlier_removal_errors",
    "num_voyages_after_sampling",
    "num_sampling_errors",
    "num_resampled_rows",
    "num_final_voyages",
    "num_final_rows",
)


class Observed:
    """Final voyage steps that count their own stages: write ``steps``, then ask for ``counters``.

    Rows are counted where they pass; a voyage or chunk is counted at its first row, and voyages
    before any message is moved at their first hour.  So nothing is read, moved or aggregated again.
    A stage that is run again after an executor is lost may count its rows twice, as all
    observed metrics may; ``of_reports`` and ``of_voyages`` count exactly then too.
    """

    def __init__(self, raw: DataFrame, speed_max: float = SPEED_MAX, choose: Choice = greedy):
        self._seen: list[tuple[Observation, tuple[str, ...]]] = []
        ok = F.coalesce(within() & F.col("ts_s").isNotNull(), F.lit(False))
        kept = self._count(raw, num_messages=ok, num_discarded_filtered=~ok).filter(ok)
        day = F.floor(F.col("slot") * slots.SLOT_S / 86400)
        hours = slots.folded(slots.slots(in_range(raw))).withColumn("_day", day)
        hours = hours.withColumn("_new_day", ~F.coalesce(F.lag("_day").over(Window.partitionBy("mmsi").orderBy("slot")) == F.col("_day"), F.lit(False)))
        first = F.col("back").isNull()
        hours = self._count(hours, num_segments=F.col("_new_day"), num_initial_voyages=first, num_voyages_after_duration_filter=first & slots.is_long())
        long = slots.joined(kept, hours.filter(slots.is_long()), "voyage").drop("_slot")
        cleaned = self._count(marked(candidates(long, speed_max), speed_max, choose), num_messages_removed=F.col("outlier")).filter("not outlier").drop("idx", "outlier")
        fine = F.col("_worst") <= GAP_S
        begun = F.col("_first")
        facts = self._count(voyages.gap_facts(cleaned.repartition("mmsi")), num_voyages_after_outlier_removal=begun, num_voyages_after_sampling=begun & fine, num_sampling_errors=begun & ~fine)
        ticks = self._count(voyages.positions(voyages.brackets(facts.filter(fine).drop("_first", "_worst"))), num_resampled_rows=F.lit(True))
        self.steps = self._count(voyages.final_steps(ticks), num_final_voyages=F.col("step") == 0, num_final_rows=F.lit(True))

    def _count(self, rows: DataFrame, **what: Column) -> DataFrame:
        seen = Observation()
        self._seen.append((seen, tuple(what)))
        return rows.observe(seen, *[F.count(F.when(c, 1)).alias(n) for n, c in what.items()])

    def counters(self) -> dict[str, int]:
        """The counters, once ``steps`` has been written or collected; it waits for that."""
        # adaptive execution may find that a stage has no rows and leave it out, with its metrics
        got = {n: seen.get[n] if seen._jo.getRow().size() else 0 for seen, names in self._seen for n in names}
        got["num_outlier_removal_errors"] = got["num_voyages_after_duration_filter"] - got["num_voyages_after_outlier_removal"]
        return {n: got[n] for n in NAMES}

    def table(self, spark: SparkSession) -> DataFrame:
        """(counter, value), as ``stacked`` has them."""
        return spark.createDataFrame(list(self.counters().items()), "counter string, value long")
