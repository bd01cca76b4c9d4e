"""A hash that other engines have too, and choices by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task may keep to find the first ones.
MOST_AT_ONCE = 10_000


def portable(*columns: str, seed: int) -> Column:
    """The MD5 of the columns as text and the seed, joined by colons, as hex digits; a null is ``null``."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns], F.lit(str(seed))).cast("binary"))


def first_by_hash(rows: DataFrame, n: int, *columns: str, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest hashes of ``columns``, all where there are no more, and the hash as ``_order``.

    Up to ``MOST_AT_ONCE`` are found in one pass: each task keeps its own ``n`` and one takes the
    first of these.  For more, rows are chosen by a threshold first, which about ``n`` of them pass, so
    only these are sorted; the threshold is doubled until enough pass.  Rows of one hash are ordered by all their columns.
    """
    hashed = rows.withColumn("_order", portable(*columns, seed=seed))
    if n <= MOST_AT_ONCE:
        return hashed.orderBy("_order", *rows.columns).limit(n)
    total = rows.count()
    share = (n + 6 * n**0.5 + 16) / max(total, 1)
    few = hashed
    while share < 1:
        few = hashed.filter(F.col("_order") < f"{int(share * 16**8):08x}")
        if few.count() >= n:
            break
        few, share = hashed, 2 * share
    return few.orderBy("_order", *rows.columns).limit(n)
