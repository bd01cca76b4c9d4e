"""Code lookups as constant maps."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.schema import NAV_STATUS, SHIP_TYPE, UNKNOWN_NAV


def _lookup(codes: dict[str, int], text: str, default: int) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(codes.items())])
    return F.coalesce(F.try_element_at(table, F.col(text)), F.lit(default))


def nav_status(text: str) -> Column:
    return _lookup(NAV_STATUS, text, UNKNOWN_NAV)


def ship_type(text: str) -> Column:
    return _lookup(SHIP_TYPE, text, 0)


def vessel_class(code: str) -> Column:
    c = F.col(code)
    return (
        F.when(c.between(70, 78), "Cargo").when(c.between(80, 88), "Tanker").when(c == 30, "Fishing").when(c.isin(36, 37), "Sailing/Pleasure").otherwise("Other")
    )
