"""Voyages of vessels of any size, by hours and a state that is carried over them.

Numbers that many senders share, or never set, can hold a large part of all messages, and a window
over a vessel can't be split.  An hour is shorter than the gap that ends a voyage, so no voyage
ends within one, and three numbers say all that others need of it: how many messages, the first
time and the last.  These are aggregated before anything is moved.  The state of a vessel (the
last time so far, the voyages and messages so far) is then folded over its hours, of which there
are as many as its times span however many messages it has; the messages take the state of their
hour.  What is left to order is an hour of a vessel at a time.

The messages are read twice for this, the first time only the columns that the hours need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftline.schema import GAP_S, LEAST_ROWS, LEAST_S

#: Seconds of a slot; at most a second more than the gap, so that no voyage ends within one.
SLOT_S = 3600


def slot(slot_s: int = SLOT_S) -> Column:
    if not 0 < slot_s <= GAP_S + 1:
        raise ValueError(f"a slot has 1 to {GAP_S + 1} seconds")
    return F.floor(F.col("ts_s") / F.lit(slot_s)).cast("long")


def slots(messages: DataFrame, slot_s: int = SLOT_S) -> DataFrame:
    """(mmsi, slot, n, first, last): each vessel's hours with a message."""
    return messages.groupBy("mmsi", slot(slot_s).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_s").alias("first"), F.max("ts_s").alias("last"))


def folded(found: DataFrame) -> DataFrame:
    """The hours with what is carried over them.

    before (the vessel's last time in an earlier hour), voyage, and of the voyage: n_voyage, t0, tn,
    back (the hour before, null for the first) and passed (messages in hours before).
    """
    vessel = Window.partitionBy("mmsi").orderBy("slot")
    voyage = Window.partitionBy("mmsi", "voyage")
    order = voyage.orderBy("slot")
    cut = F.when(F.col("first") - F.col("before") > GAP_S, 1).otherwise(0)
    rows = found.withColumn("before", F.lag("last").over(vessel)).withColumn("voyage", F.sum(cut).over(vessel.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumns(
        {
            "n_voyage": F.sum("n").over(voyage),
            "t0": F.min("first").over(voyage),
            "tn": F.max("last").over(voyage),
            "back": F.lag("slot").over(order),
            "passed": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )


def is_long() -> Column:
    """Whether an hour's voyage has 20 messages or more over four hours or more."""
    return (F.col("n_voyage") >= LEAST_ROWS) & (F.col("tn") - F.col("t0") >= LEAST_S)


def stats(messages: DataFrame, only_long: bool = False, slot_s: int = SLOT_S) -> DataFrame:
    """(mmsi, voyage, n, t0, tn) of every voyage, or every long one, from the hours alone: no message is moved."""
    of = folded(slots(messages, slot_s)).filter("back is null")
    return (of.filter(is_long()) if only_long else of).select("mmsi", "voyage", F.col("n_voyage").alias("n"), "t0", "tn")


def placed(messages: DataFrame, *facts: str, only_long: bool = False, slot_s: int = SLOT_S) -> DataFrame:
    """The messages with ``_slot`` and the named facts of their hour; with ``only_long``, those of long voyages.

    Messages without a time have no hour and go.
    """
    table = folded(slots(messages, slot_s))
    return joined(messages, table.filter(is_long()) if only_long else table, *facts, slot_s=slot_s)


def joined(messages: DataFrame, table: DataFrame, *facts: str, slot_s: int = SLOT_S) -> DataFrame:
    """The messages whose hour is in a ``folded`` table, with ``_slot`` and the named facts of it."""
    table = table.select(F.col("mmsi").alias("_of"), F.col("slot").alias("_at"), *facts)
    rows = messages.withColumn("_slot", slot(slot_s))
    return rows.join(table, rows["mmsi"].eqNullSafe(table["_of"]) & (rows["_slot"] == table["_at"])).drop("_of", "_at")


def in_slot() -> WindowSpec:
    return Window.partitionBy("mmsi", "_slot").orderBy("ts_s", "seq")


def with_gaps(messages: DataFrame, slot_s: int = SLOT_S) -> DataFrame:
    """gap_s (seconds since the vessel's message before, null for the first) and voyage of each message."""
    rows = placed(messages, "before", "voyage", slot_s=slot_s)
    return rows.withColumn("gap_s", F.col("ts_s") - F.coalesce(F.lag("ts_s").over(in_slot()), F.col("before"))).drop("_slot", "before")


def indexed(messages: DataFrame, slot_s: int = SLOT_S) -> DataFrame:
    """The messages of long voyages with ``idx``, their place in the voyage."""
    rows = placed(messages, "voyage", "passed", only_long=True, slot_s=slot_s)
    return rows.withColumn("idx", (F.col("passed") + F.row_number().over(in_slot()) - 1).cast("int")).drop("_slot", "passed")


def with_followers(messages: DataFrame, columns: tuple[str, ...], slot_s: int = SLOT_S) -> DataFrame:
    """The messages of long voyages with voyage, t0, tn and, as ``{column}2``, their follower's columns; a voyage's last message goes.

    An hour's last message is followed by the first one of the voyage's next hour, so the messages
    of an hour's first second are sent to the hour before too.
    """
    rows = placed(messages, "voyage", "t0", "tn", "first", "back", only_long=True, slot_s=slot_s)
    both = rows.withColumn("_in", F.explode(F.array_compact(F.array("_slot", F.when(F.col("ts_s") == F.col("first"), F.col("back"))))))
    w = Window.partitionBy("mmsi", "_in").orderBy("ts_s", "seq")
    ahead = both.select("*", *[F.lead(c).over(w).alias(f"{c}2") for c in columns])
    return ahead.filter((F.col("_in") == F.col("_slot")) & F.col("ts_s2").isNotNull()).drop("_in", "_slot", "first", "back")
