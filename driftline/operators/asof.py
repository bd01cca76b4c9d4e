"""As-of join: each row with the last row of another table at or before its time.

Both tables are one stream by key and time, and the last right row is carried forward to the left
ones: no range is joined.  A key may hold any share of the rows, so the stream is cut into slots of time.
The last right row of each slot is aggregated first, carried over the key's slots (as many as its times
span), and taken by the left rows that have none in their own slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a slot in the units of the time column.
SLOT = 3600


def _free(names: set[str], wanted: str) -> str:
    while wanted in names:
        wanted += "_"
    return wanted


def asof_join(
    left: DataFrame, right: DataFrame, by: str | list[str], at: str = "ts_s", order: str | list[str] = (), how: str = "left", strict: bool = False, tolerance: float | None = None, slot: float = SLOT, suffix: str = "_right"
) -> DataFrame:
    """``left`` with the columns of the last ``right`` row of equal keys whose time is at or before its own.

    ``at`` is a numeric column of both tables.  Right rows of one time are ranked by ``order``
    (columns of ``right``, the largest wins, nulls first); without it any of them may be taken.
    ``strict`` leaves out equal times, ``tolerance`` rows that are more than that before.  ``how`` is "left", where left rows
    without a match have nulls, or "inner".  Every left row comes out once at most, repeated ones
    too.  Null keys or times match nothing.  The keys come from ``left``; other right columns whose names
    ``left`` has, the time among them, get the suffix.
    """
    keys, ties = [by] if isinstance(by, str) else list(by), [order] if isinstance(order, str) else list(order)
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    if slot <= 0:
        raise ValueError("a slot has a width")
    taken = [c for c in right.columns if c not in keys]
    used = {*left.columns, *right.columns}
    time, side, rank, row, own, found, place, before = (_free(used, f"_{n}") for n in ("time", "side", "rank", "row", "own", "found", "place", "before"))
    # at one time right rows come first, or last where equal times don't count
    first, last = (1, 0) if strict else (0, 1)
    fixed = lambda frame: [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)] + [F.col(at).alias(time), F.floor(F.col(at) / F.lit(slot)).cast("long").alias(place)]
    ranked = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(ties)])
    body = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(taken)], F.col(at).alias("at"))
    of_right = right.select(*fixed(right), F.lit(first).alias(side), ranked.alias(rank), body.alias(row)).dropna(subset=[*[f"_k{i}" for i in range(len(keys))], time])
    of_left = left.select(*fixed(left), F.lit(last).alias(side), F.struct(*[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(left.columns)]).alias(own))
    stream = of_right.unionByName(of_left, allowMissingColumns=True)
    ids = [f"_k{i}" for i in range(len(keys))]
    is_right = F.col(row).isNotNull()
    last_of = stream.groupBy(*ids, place).agg(F.max_by(row, F.when(is_right, F.struct(time, rank))).alias(before))
    carried = F.last(before, ignorenulls=True).over(Window.partitionBy(*ids).orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    carry = last_of.select(*ids, place, carried.alias(before)).filter(F.col(before).isNotNull())
    both = stream.join(carry, [*ids, place], "left")
    w = Window.partitionBy(*ids, place).orderBy(time, side, rank).rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumn(found, F.coalesce(F.last(row, ignorenulls=True).over(w), F.col(before))).filter(F.col(own).isNotNull())
    if tolerance is not None:
        matched = matched.withColumn(found, F.when(F.col(time) - F.col(f"{found}.at") <= tolerance, F.col(found)))
    if how == "inner":
        matched = matched.filter(F.col(found).isNotNull())
    names = [c + suffix if c in left.columns else c for c in taken]
    return matched.select(*[F.col(f"{own}.l{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"{found}.c{i}").alias(n) for i, n in enumerate(names)])
