"""Geodesics on the WGS84 ellipsoid by Vincenty's formulae, as projections of built-in functions.

A fixed number of iterations keeps the plan static; within the bounds of the data six agree
with the converged result to nanometres.  The steps are separate projections, so each
intermediate is computed once; they are given to the session as one query, which is analysed
once.  Don't filter on a result directly: the optimiser pushes such a
filter through all steps and writes the formula out; ``speed_edges`` shows a way around that.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

# The ellipsoid.
A = 6378137.0
FLAT = 1 / 298.257223563
B = A * (1 - FLAT)
ITERATIONS = 6


def _through(df: DataFrame, steps: list[dict[str, str]], found: dict[str, str]) -> DataFrame:
    """``df`` with the columns ``found``, after projections that each see the ones before.

    A step's column is carried on only as far as a later step reads it, so the projections stay narrow.
    """
    kept = [f"`{c}`" for c in df.columns if c not in found]
    later = [" ".join(x.values()) for x in [*steps[1:], found]]
    text, known = "select * from {src}", []
    for i, step in enumerate(steps):
        read = set(re.findall(r"\b_\w+", " ".join(later[i:])))
        text = f"select {', '.join(['*'] if not i else [*(f'`{c}`' for c in df.columns), *(n for n in known if n in read)])}, {', '.join(f'{e} as {n}' for n, e in step.items())} from ({text})"
        known += step
    return df.sparkSession.sql(f"select {', '.join([*kept, *(f'{e} as `{n}`' for n, e in found.items())])} from ({text})", src=df)


_SERIES = {
    "_A": "1 + _w / 16384 * (4096 + _w * (-768 + _w * (320 - 175 * _w)))",
    "_B": "_w / 1024 * (256 + _w * (-128 + _w * (74 - 47 * _w)))",
}


def _correction(ss: str, cs: str, c2m: str) -> str:
    return f"_B * {ss} * ({c2m} + _B / 4 * ({cs} * (-1 + 2 * {c2m} * {c2m}) - _B / 6 * {c2m} * (-3 + 4 * {ss} * {ss}) * (-3 + 4 * {c2m} * {c2m})))"


def with_inverse(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, distance: str, azimuth: str | None = None) -> DataFrame:
    """Add the distance in metres (0 for coincident points, null for null ends) and, if named, the first azimuth in radians."""
    f = f"{FLAT!r}D"
    reduced = lambda lat: f"atan((1 - {f}) * tan(radians(`{lat}`)))"
    steps = [
        {"_l": f"radians(`{lon2}`) - radians(`{lon1}`)", "_u1": reduced(lat1), "_u2": reduced(lat2)},
        {"_su1": "sin(_u1)", "_cu1": "cos(_u1)", "_su2": "sin(_u2)", "_cu2": "cos(_u2)", "_lam0": "_l"},
    ]
    for i in range(ITERATIONS):
        lam, ss, cs, sig, sa, c2m, c = (f"_{n}{i}" for n in ("lam", "ss", "cs", "sig", "sa", "c2m", "c"))
        x, y = f"(_cu2 * sin({lam}))", f"(_cu1 * _su2 - _su1 * _cu2 * cos({lam}))"
        c2a = f"(1 - {sa} * {sa})"
        steps += [
            {ss: f"sqrt({x} * {x} + {y} * {y})", cs: f"_su1 * _su2 + _cu1 * _cu2 * cos({lam})"},
            {sig: f"atan2({ss}, {cs})", sa: f"case when {ss} = 0 then 0D else _cu1 * _cu2 * sin({lam}) / nullif({ss}, 0D) end"},
            {c2m: f"case when {c2a} = 0 then 0D else {cs} - 2 * _su1 * _su2 / nullif({c2a}, 0D) end", c: f"{f} / 16 * {c2a} * (4 + {f} * (4 - 3 * {c2a}))"},
            {f"_lam{i + 1}": f"_l + (1 - {c}) * {f} * {sa} * ({sig} + {c} * {ss} * ({c2m} + {c} * {cs} * (-1 + 2 * {c2m} * {c2m})))"},
        ]
    steps += [{"_w": f"{c2a} * {(A * A - B * B) / (B * B)!r}D"}, _SERIES]
    found = {distance: f"case when {ss} = 0 then 0D else {B!r}D * _A * ({sig} - ({_correction(ss, cs, c2m)})) end"}
    if azimuth:
        lam = f"_lam{ITERATIONS}"
        found[azimuth] = f"atan2(_cu2 * sin({lam}), _cu1 * _su2 - _su1 * _cu2 * cos({lam}))"
    return _through(df, steps, found)


def inverse(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Distances in metres by the same formula over numpy arrays; nan for a nan end."""
    turn = np.radians(lon2) - np.radians(lon1)
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = turn
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(ITERATIONS):
            ss = np.hypot(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam))
            cs = su1 * su2 + cu1 * cu2 * np.cos(lam)
            sig = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * np.sin(lam) / ss)
            c2a = 1 - sa * sa
            c2m = np.where(c2a == 0, 0.0, cs - 2 * su1 * su2 / c2a)
            c = FLAT / 16 * c2a * (4 + FLAT * (4 - 3 * c2a))
            lam = turn + (1 - c) * FLAT * sa * (sig + c * ss * (c2m + c * cs * (-1 + 2 * c2m * c2m)))
    w = c2a * (A * A - B * B) / (B * B)
    big = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
    small = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    gone = small * ss * (c2m + small / 4 * (cs * (-1 + 2 * c2m * c2m) - small / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m)))
    return np.where(ss == 0, 0.0, B * big * (sig - gone))


def with_direct(df: DataFrame, lat1: str, lon1: str, azimuth: str, distance: str, lat2: str, lon2: str) -> DataFrame:
    """Add the point reached from (lat1, lon1) at an azimuth in radians after a distance in metres."""
    f = f"{FLAT!r}D"
    gone = f"`{distance}` / ({B!r}D * _A)"
    steps = [
        {"_tu": f"(1 - {f}) * tan(radians(`{lat1}`))", "_sz": f"sin(`{azimuth}`)", "_cz": f"cos(`{azimuth}`)"},
        {"_cu": "1 / sqrt(1 + _tu * _tu)", "_s1": "atan2(_tu, _cz)"},
        {"_su": "_tu * _cu", "_sa": "_cu * _sz"},
        {"_c2a": "1 - _sa * _sa"},
        {"_w": f"_c2a * {(A * A - B * B) / (B * B)!r}D"},
        _SERIES,
        {"_sig0": gone},
    ]
    for i in range(ITERATIONS):
        steps += [
            {f"_c2m{i}": f"cos(2 * _s1 + _sig{i})", f"_ss{i}": f"sin(_sig{i})", f"_cs{i}": f"cos(_sig{i})"},
            {f"_sig{i + 1}": f"{gone} + {_correction(f'_ss{i}', f'_cs{i}', f'_c2m{i}')}"},
        ]
    sig = f"_sig{ITERATIONS}"
    steps += [
        {"_c2m": f"cos(2 * _s1 + {sig})", "_ss": f"sin({sig})", "_cs": f"cos({sig})"},
        {"_t": "_su * _ss - _cu * _cs * _cz", "_c": f"{f} / 16 * _c2a * (4 + {f} * (4 - 3 * _c2a))"},
        {"_turn": f"atan2(_ss * _sz, _cu * _cs - _su * _ss * _cz) - (1 - _c) * {f} * _sa * ({sig} + _c * _ss * (_c2m + _c * _cs * (-1 + 2 * _c2m * _c2m)))"},
    ]
    phi = f"atan2(_su * _cs + _cu * _ss * _cz, (1 - {f}) * sqrt(_sa * _sa + _t * _t))"
    return _through(df, steps, {lat2: f"degrees({phi})", lon2: f"`{lon1}` + degrees(_turn)"})
