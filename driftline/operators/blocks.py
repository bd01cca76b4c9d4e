"""All pairs of very many vectors, in blocks of bounded size.

The vectors are dealt into blocks by a hash, and each pair of blocks meets in one group.  A vector is
sent once for every block, so the number of blocks says what is shuffled: it is the same for tables of
any size until a block would hold more than ``NUMBERS`` numbers.  Only then do blocks become more.
Within a group distances come from matrix products, one tile at a time.  Where most pairs are only to be ruled out,
products in single precision do so; what their rounding leaves open is measured again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clustering import matrix

#: Numbers of a block of vectors, at most.
NUMBERS = 1 << 22
#: Blocks of a table that needs no more by its size, and the rows that are worth a block of their own.
SPREAD, FEW = 24, 512
#: Rows and columns of a tile of distances.
ROWS, COLUMNS = 128, 1024
#: A tile of which more than one in so many pairs is left by single precision is made again in double precision.
FEW_OF = 16


def how_many(n: int, dims: int, spread: int = SPREAD, few: int | None = None) -> int:
    """Blocks for ``n`` vectors of so many numbers."""
    return max(1, -(-n * max(1, dims) // NUMBERS), min(spread, -(-n // (few or FEW))))


def width(rows: DataFrame, vector: str = "v") -> int:
    """The numbers of a vector."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def tiles(x: np.ndarray, y: np.ndarray, same: bool = False, unit: float = 0.0) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, squared distances from there on): each tile of all pairs, only good until the next one.

    With ``same``, those that lie wholly at or below the diagonal are left out.  Squares are off by ``rounding`` at most, and may be negative.
    With a ``unit`` they are of single precision, and of vectors in that unit.
    """
    centre, kind = y.mean(0) if len(y) else 0.0, np.float32 if unit else np.float64
    x, y = x - centre, y - centre
    if unit:
        x, y = x / unit, y / unit
    left = np.column_stack([-2 * x, (x * x).sum(1), np.ones(len(x))]).astype(kind, copy=False)
    right = np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), (y * y).sum(1)]).T, kind)
    held = np.empty(ROWS * COLUMNS, kind)
    for r in range(0, len(x), ROWS):
        for c in range(0, len(y), COLUMNS):
            rows, columns = min(ROWS, len(x) - r), min(COLUMNS, len(y) - c)
            if same and c + columns <= r + 1:
                continue
            yield r, c, np.matmul(left[r : r + rows], right[:, c : c + columns], out=held[: rows * columns].reshape(rows, columns))


def _most(x: np.ndarray, y: np.ndarray) -> float:
    """The square of the greatest length from the centre of ``tiles``."""
    if not len(x) or not len(y):
        return 0.0
    centre = y.mean(0)
    return max(float(((x - centre) ** 2).sum(1).max()), float(((y - centre) ** 2).sum(1).max()))


def rounding(x: np.ndarray, y: np.ndarray, unit: float = 0.0) -> float:
    """How far a square of ``tiles`` can be off, in the vectors' own measure; with a ``unit``, one of single precision."""
    return 8 * (x.shape[1] + 8) * float(np.finfo(np.float32 if unit else float).eps) * _most(x, y)


def single(x: np.ndarray, y: np.ndarray) -> float:
    """The unit, a power of two, in which single precision holds the vectors at any scale; 0 where it can't."""
    most = _most(x, y)
    if not 1e-280 < most < 1e280:
        return 0.0
    return float(2.0 ** np.ceil(np.log2(most) / 2))


def lengths(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of the pairs (i, j) by differences, some at a time."""
    out = np.empty(len(i))
    step = max(1, (1 << 20) // max(1, x.shape[1]))
    for at in range(0, len(i), step):
        out[at : at + step] = np.sqrt(((x[i[at : at + step]] - y[j[at : at + step]]) ** 2).sum(1))
    return out


def met(rows: DataFrame, blocks: int, measure: Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray, bool], pa.Table], out: T.StructType) -> DataFrame:
    """What ``measure`` gives for each pair of blocks of ``rows`` (id, v and others): (rows, vectors) of both, and whether they are one block."""
    columns = rows.columns
    block, other = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = rows.withColumn("_block", block).withColumn("_other", other)
    low = F.col("_block") <= F.col("_other")
    sent = sent.select(F.least("_block", "_other").alias("_p"), F.greatest("_block", "_other").alias("_q"), low.alias("_low"), *columns)
    groups = blocks * (blocks + 1) // 2

    def run(part: pa.Table) -> pa.Table:
        same = part.column("_p")[0].as_py() == part.column("_q")[0].as_py()
        sides = [part.combine_chunks()] if same else [part.filter(part.column("_low")).combine_chunks(), part.filter(pc.invert(part.column("_low"))).combine_chunks()]
        vectors = [matrix(s.column("v").combine_chunks()) if s.num_rows else np.zeros((0, 1)) for s in sides]
        if not all(s.num_rows for s in sides):
            return pa.table({f.name: pa.array([]) for f in out.fields}).cast(_arrow(out))
        return measure(sides[0], vectors[0], sides[-1], vectors[-1], same)

    return sent.repartition(groups, "_p", "_q").groupBy("_p", "_q").applyInArrow(run, out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
