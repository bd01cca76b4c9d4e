"""Periodic runs of words, by bit-parallel lags.

A text's words are numbered, and bit ``i`` of plane ``b`` is bit ``b`` of word ``i``'s number; a plane is
one big integer.  For a lag, every plane is XORed with itself shifted by the lag and the results
are ORed: a zero is a place whose word comes again a lag later.  A run of period q shows as at
least ``max(LEAST_WORDS, 2 * q) - q`` zeros in a row, which AND with shifted copies, doubling the
stretch each time, isolates for all places at once.

A stretch of q zeros holds a whole aligned block of s words for every s <= (q + 1) / 2.  So a lag
is only tried where some aligned block's fingerprint comes again at that lag, which one comparison
of 2 n places shows for all lags of an octave; a fingerprint can only let a lag in that has no run.

Lags rise.  A stretch of a multiple of its smallest period is found at that period first, with
the same ends, so what has been found before is no new run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import batches_out, table

#: A run has this many words or more, and two whole periods.
LEAST_WORDS = 12
#: Lags up to this are tried without asking for blocks.
SHORT_LAGS = 6
#: Places compared at once when blocks are asked for.
PLACES = 1 << 22

_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


def lags(numbers: np.ndarray) -> list[int]:
    """The lags, rising, at which a run is possible."""
    n = len(numbers)
    found = list(range(1, min(SHORT_LAGS, n // 2) + 1))
    size = 4
    with np.errstate(over="ignore"):
        prints = (numbers.astype(np.uint64) + np.uint64(1)) * _STEP
        prints ^= prints >> np.uint64(29)
        for half in (1, 2):
            prints = prints[:-half] * _TURN + prints[half:] if len(prints) > half else prints[:0]
        while 2 * size - 1 <= n // 2 and len(prints):
            first, last = 2 * size - 1, min(4 * size - 2, n // 2)
            # a place beyond the end is compared with a print that it may even have: that lets a lag in, no more
            beyond = np.concatenate([prints, np.zeros(last + 1, np.uint64)])
            starts = np.arange(0, len(prints), size)
            some = np.zeros(last - first + 1, bool)
            for part in np.array_split(starts, max(1, len(starts) * len(some) // PLACES)):
                ahead = np.lib.stride_tricks.sliding_window_view(beyond, last - first + 1)[part + first] if len(part) else np.zeros((0, len(some)), np.uint64)
                some |= (ahead == prints[part][:, None]).any(0)
            found += (np.flatnonzero(some) + first).tolist()
            prints = prints[:-size] * _TURN + prints[size:] if len(prints) > size else prints[:0]
            size *= 2
    return found


def planes(numbers: np.ndarray) -> list[int]:
    """One big integer for each bit of the largest number, place 0 lowest."""
    most = int(numbers.max(initial=0))
    return [int.from_bytes(np.packbits((numbers >> b) & 1, bitorder="little").tobytes(), "little") for b in range(most.bit_length())]


def _ones(bits: int, n: int) -> np.ndarray:
    """The places of the bits that are set."""
    raw = np.frombuffer(bits.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def runs(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(numbers)
    if n < LEAST_WORDS:
        return []
    sides = planes(numbers)
    seen: set[tuple[int, int]] = set()
    found = []
    for q in lags(numbers):
        need = max(LEAST_WORDS, 2 * q) - q
        if need + q > n:
            break
        differ = 0
        for side in sides:
            differ |= side ^ (side >> q)
        equal = (1 << (n - q)) - 1
        equal ^= equal & differ
        wide = 1
        while wide < need and equal:
            step = min(wide, need - wide)
            equal &= equal >> step
            wide += step
        if not equal:
            continue
        starts, lasts = _ones(equal & ~(equal << 1), n), _ones(equal & ~(equal >> 1), n)
        for a, b in zip(starts.tolist(), lasts.tolist(), strict=True):
            stretch = (a, b - a + need + q)
            if stretch not in seen:
                seen.add(stretch)
                found.append((*stretch, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Whether a word lies in some run behind that run's first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) > 0


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, runs (start, length, period) and ``collapsed``: the words outside all repetitions, joined by one space.

    Every row gives one row, whatever its key, which may be null or repeat and keeps its type.  A
    null text, an empty one and one of white space have no words, no runs and an empty collapse;
    texts of any length are worked on whole.  An empty table gives no rows; other columns are left.
    Runs are stretches of consecutive words with smallest period q and ``max(LEAST_WORDS, 2 * q)`` words
    or more, which no neighbouring word extends; runs that overlap or nest are all reported.
    """
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for batch in W.chunks(whole):
                parts = W.split(batch.column(1), None)
                ends = parts.offsets.tolist()
                for name, a, b in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                    codes = parts.codes[a:b]
                    distinct, numbers = np.unique(codes, return_inverse=True)
                    found = runs(numbers)
                    kept = codes[~repeated(found, b - a)] if found else codes
                    yield name, b - a, [dict(zip(_RUN.names, r, strict=True)) for r in found], b" ".join([parts.distinct[c] for c in kept.tolist()]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), out, lambda r: len(r[3]) + 100 * len(r[2]))

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, out)


def looped(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of documents, one in ten with a tail that repeats, as the hash of its id says.

    Without an id there is no hash, and the text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_w"), g.alias("_g"))
    n = F.size("_w")
    # a text without words has no place to start from; a remainder by zero would end the run
    start = F.col("_g") % F.nullif(n, F.lit(0))
    rows = rows.withColumns({"_a": start.cast("int"), "_p": (1 + F.floor((n - start) / (3 + F.col("_g") % 8))).cast("int")})

    def word(i: Column) -> Column:
        return F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")))

    tail = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return rows.select("doc_id", F.when(n > 0, tail).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The runs of ``find`` as counts, the longest one, and checksums of all of them and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.withColumn("_b", longest)
    return best.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_b.start")).alias("start"),
        F.col("_b.length").alias("length"),
        (-F.col("_b.period")).alias("period"),
        F.floor(1000 * F.col("_b.length") / -F.col("_b.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def op12_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, once one document in ten has been made to loop; ``find`` states nulls, empty texts, repeats and empty tables."""
    return digest(find(looped(table(spark, sf_dir, "documents"))))


#: CRC-32 of a number's decimal digits, bit by bit: ``{0}`` is a bigint expression.
CRC32 = (
    "xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast({0} as varchar), ''), lambda ch: cast(ascii(ch) as bigint))), "
    "lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end)))"
)

#: A run's words that come again a period later hold six in a row, so places that share six words meet.
ORACLE = (
    r"""
with recursive h as (select doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) as w, """
    + CRC32.format("doc_id")
    + r""" as h from documents),
g as (select *, len(w) as n, h // 10 as g from h),
ap as (select *, case when n > 0 then g % n end as a, case when n > 0 then 1 + (n - g % n) // (3 + g % 8) end as p from g),
d as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) else w end as w from ap),
x as (select doc_id, n, unnest(range(0, n - 5)) as i, unnest(list_transform(range(1, n - 4), lambda i: md5_number(list_aggregate(w[i:i + 5], 'string_agg', ' ')))) as k from d where n >= 12),
same as (select u.doc_id, u.n, v.i - u.i as q, u.i from x u join x v on u.doc_id = v.doc_id and u.k = v.k and v.i > u.i and 2 * (v.i - u.i) <= u.n),
isle as (select *, i - row_number() over (partition by doc_id, q order by i) as part from same),
stretch as (select doc_id, q, min(i) as start, count(*) + 5 + q as length from isle group by doc_id, q, part),
run as (select doc_id, start, length, min(q) as period from stretch where length >= greatest(12, 2 * q) group by doc_id, start, length),
agg as (select doc_id, count(*) as n_runs, first(struct_pack(s := start, l := length, p := period) order by length desc, start, period) as b,
  string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines, list(struct_pack(a := start + period, b := start + length)) as parts from run group by doc_id),
gone as (select distinct doc_id, unnest(range(e.a, e.b)) as i from (select doc_id, unnest(parts) as e from agg)),
kept as (select w.doc_id, string_agg(w.word, ' ' order by w.i) as text from (select doc_id, unnest(range(0, n)) as i, unnest(w) as word from d) w left join gone using (doc_id, i) where gone.i is null group by w.doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, b.s as start, b.l as length, b.p as period, b.l * 1000 // b.p as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256, d.n as n_words
from d left join agg using (doc_id) left join kept using (doc_id)
"""
)
