"""Mergeable summaries by day: how many vessels, and how values are spread, over any range of days.

A day (or a vessel's day) is read once and leaves a HyperLogLog sketch of its vessels and KLL sketches of its values.
Any range, and any set of vessels, is then a union of sketches: a few kilobytes a day, whatever the day held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: HyperLogLog with 2 ** 12 registers; KLL of accuracy 200.
LG_K, K = 12, 200
#: Relative error of a number of vessels, four standard errors, and error of a quantile's rank, twice the one that 99 of 100 keep.
COUNT_ERROR = 4 * 1.04 / 2 ** (LG_K / 2)
RANK_ERROR = 2 * 2.296 / K**0.9723
VALUES = ("lat", "lon", "sog")


def daily(messages: DataFrame, *by: str, values: tuple[str, ...] = VALUES) -> DataFrame:
    """By file_date and ``by``: ``vessels``, and ``{value}s`` for each value.  Nulls and NaNs are in no sketch of values, null vessels in none of vessels."""
    number = lambda c: F.when(~F.isnan(F.col(c)), F.col(c)).cast("double")
    return messages.groupBy("file_date", *by).agg(F.hll_sketch_agg("mmsi", LG_K).alias("vessels"), *[F.kll_sketch_agg_double(number(c), K).alias(f"{c}s") for c in values])


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """The unions of the sketches of ``daily``, or of earlier unions, for each of ``by`` (all of them in one row without)."""
    values = [c for c in sketches.columns if c in {f"{v}s" for v in VALUES}]
    return sketches.groupBy(*by).agg(F.hll_union_agg("vessels").alias("vessels"), *[F.kll_merge_agg_double(c, K).alias(c) for c in values])


def rolling(sketches: DataFrame, days: int) -> DataFrame:
    """For each day with a sketch, as ``file_date``, the union of it and the days before, ``days`` in all.

    A day's sketches are sent to the days that they count for; no range is joined.
    """
    ends = F.sequence("file_date", F.date_add("file_date", days - 1))
    there = sketches.select(F.col("file_date").alias("last")).distinct()
    spread = sketches.withColumn("last", F.explode(ends)).join(there, "last", "left_semi")
    return merged(spread.drop("file_date"), "last").withColumnRenamed("last", "file_date")


def n_vessels(sketch: str = "vessels") -> Column:
    """An estimate within ``COUNT_ERROR``."""
    return F.hll_sketch_estimate(sketch)


def n_values(sketch: str) -> Column:
    """Exact."""
    return F.kll_sketch_get_n_double(sketch)


def quantile(sketch: str, share: float) -> Column:
    """A value whose rank is within ``RANK_ERROR`` of ``share``; null without values."""
    return F.when(n_values(sketch) > 0, F.kll_sketch_get_quantile_double(F.when(n_values(sketch) > 0, F.col(sketch)), F.lit(share)))
