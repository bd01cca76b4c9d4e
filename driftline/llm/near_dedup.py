"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A text's set holds its distinct five-word shingles as 64-bit fingerprints.  Its signature has
``CHUNKS * WIDTH`` MinHash values of 16 bits.  Two signatures that differ in at most
``CHUNKS * (ERRORS + 1) - 1`` places agree, by the pigeonhole principle, on some chunk but for
``ERRORS`` places; so each chunk is entered once for every choice of the places left out, and
all pairs under that distance meet under some key.  At a similarity of 0.75 a pair that is
beyond it (1 in 100) still meets but for 1 in 160,000.

What meets is compared by four bits of 128 MinHash values (at most ``SKETCH_LIMIT`` may differ; at
0.75 one pair in ten million is further apart) and by set size, and is then confirmed on the
full sets.  No pairs within a group are emitted:

1. texts with equal sets become one node;
2. under each key, nodes meet the smallest one only; each node's smallest near partner, its
   hub, is confirmed on the full sets, and the links make components;
3. keys whose nodes are in one component are done; under the others, pairs of nodes in
   different components are compared, those that can be links confirmed, and the components
   made anew.

So every pair that meets is in one component or was compared.  The comparison in step 3 has an
exact bound: nodes with one hub carry bit sets of the hub's shingles they lack and of their
shingles that the hub lacks, hashed to ``MARKS`` places, which limit how many shingles two of
them can share.  Copies that were each edited in other places are told apart by it without
their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .components import components
from .shared import batches_out, cut, table

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
CHUNKS, WIDTH, ERRORS = 12, 5, 1
PLACES = 128
SKETCH_BITS = 4
SKETCH_LIMIT = 55
MARKS = 512
#: Rows of a key that are compared in one task; larger keys are dealt into blocks.
BUCKET = 16384
#: Pairs of rows whose facts are held at once.
PAIRS = 1 << 19
#: Shingles hashed together for one text.
BLOCK = 4096

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _factors(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct shingle fingerprints; a text without words has none, and a short one has one."""
    found = W.split(texts)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.distinct), np.uint64, len(found.distinct))
    h = hashes[found.codes] if len(found.codes) else np.zeros(0, np.uint64)
    n = len(h)
    rolled = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * _BASE + h[k : n - SHINGLE + 1 + k] if n >= SHINGLE else rolled
    rolled = _mix(rolled)
    out = []
    ends = found.offsets.tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for v in h[a:b]:
                x = x * _BASE + v
            out.append(_mix(np.array([x ^ _BASE])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[at : at + BLOCK, None] * factors).min(0), out=least)
    return least


_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("d1", T.LongType()),
        T.StructField("d2", T.LongType()),
        T.StructField("sketch", T.ArrayType(T.LongType())),
        T.StructField("signature", T.BinaryType()),
    ]
)


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, set size, a 128-bit digest of the set, the sketch and the signature of 16-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, factors = to_arrow_schema(_SIGNED), _factors(PLACES)
        each = 64 // SKETCH_BITS
        shifts = np.uint64(SKETCH_BITS) * np.arange(each, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in W.chunks(whole):
                    sets = shingle_sets(batch.column(1))
                    n = np.array([len(s) for s in sets], np.int64)
                    least = np.array([_minima(s, factors) for s in sets]).reshape(-1, PLACES)
                    short = (_mix(least) >> np.uint64(48)).astype("<u2")
                    low = (short & ((1 << SKETCH_BITS) - 1)).astype(np.uint64).reshape(len(sets), -1, each)
                    sketch = (low << shifts).sum(2).view(np.int64)
                    places = np.arange(len(sets) + 1, dtype=np.int32) * sketch.shape[1]
                    digests = np.array([[xxhash.xxh3_64_intdigest(s.tobytes(), seed) for seed in (1, 2)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                    none = n == 0
                    signature = [None if e else v.tobytes() for e, v in zip(none, short[:, : CHUNKS * WIDTH], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).cast(pa.int64()), pa.array(n), pa.array(digests[:, 0], mask=none), pa.array(digests[:, 1], mask=none), pa.ListArray.from_arrays(pa.array(places), pa.array(sketch.ravel())), pa.array(signature, pa.binary())],
                        schema=arrow,
                    )

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, _SIGNED)


def chunk_keys(signed: DataFrame) -> DataFrame:
    """(key, id): each signature under every chunk with every choice of ``ERRORS`` places left out."""
    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType())])
    kept = [c * WIDTH + np.array(p) for c in range(CHUNKS) for p in combinations(range(WIDTH), WIDTH - ERRORS)]
    if WIDTH - ERRORS > 4:
        raise ValueError("a key holds four places of 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, salts = to_arrow_schema(out), _factors(len(kept))
        shifts = np.uint64(16) * np.arange(WIDTH - ERRORS, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    ids = part.column(0).to_numpy()
                    values = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(len(ids), -1).astype(np.uint64)
                    keys = np.stack([_mix((values[:, p] << shifts).sum(1) ^ s) for p, s in zip(kept, salts, strict=True)], 1)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, len(kept)))], schema=arrow)

    return signed.select("id", "signature").mapInArrow(run, out)


def _near(a: str, b: str) -> str:
    """Whether two nodes' sketches and sizes leave a link possible."""
    words = PLACES * SKETCH_BITS // 64
    ones = sum(1 << i for i in range(0, 64, SKETCH_BITS))
    differ = " + ".join(
        "bit_count((" + " | ".join([f"({a}.sketch[{i}] ^ {b}.sketch[{i}])", *(f"shiftrightunsigned({a}.sketch[{i}] ^ {b}.sketch[{i}], {k})" for k in range(1, SKETCH_BITS))]) + f") & {ones}L)" for i in range(words)
    )
    return f"{DENOMINATOR} * least({a}.n, {b}.n) >= {NUMERATOR} * greatest({a}.n, {b}.n) and {differ} <= {SKETCH_LIMIT}"


_OPEN = ("key", "p", "q", "own", "id", "c", "n", "hub", "hub_n", "hidden", "sketch", "lost", "novel")


def _candidates(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a > b) of one bucket's rows in different components that sketches, sizes and bit sets allow."""
    a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ones = np.uint64(sum(1 << i for i in range(0, 64, SKETCH_BITS)))
    # by size: a row meets only those before it that are large enough
    order = np.argsort(rows["n"], kind="stable")
    rows = {k: v[order] for k, v in rows.items()}
    sketch, n, across = rows["sketch"], rows["n"], rows["p"][0] != rows["q"][0]
    first = np.searchsorted(DENOMINATOR * n, NUMERATOR * n)
    at, total = 0, len(n)
    while at < total:
        # as many rows as keep the pairs in bounds, one at least
        stop = at + 1
        while stop < total and (stop + 1 - at) * (stop + 1 - first[at]) <= PAIRS:
            stop += 1
        i, j = slice(at, stop), slice(int(first[at]), stop)
        may = (np.arange(at, stop)[:, None] > np.arange(j.start, stop)) & (rows["c"][i, None] != rows["c"][j])
        may &= DENOMINATOR * n[j] >= NUMERATOR * n[i, None]
        if across:
            may &= rows["own"][i, None] != rows["own"][j]
        x, y = np.nonzero(may)
        x, y = x + at, y + j.start
        at = stop
        differ = sketch[x] ^ sketch[y]
        mixed = differ.copy()
        for k in range(1, SKETCH_BITS):
            mixed |= differ >> np.uint64(k)
        near = np.bitwise_count(mixed & ones).sum(1) <= SKETCH_LIMIT
        x, y = x[near], y[near]
        lost = np.bitwise_count(rows["lost"][x] | rows["lost"][y]).sum(1).astype(np.int64)
        new = np.bitwise_count(rows["novel"][x] & rows["novel"][y]).sum(1).astype(np.int64)
        shared = rows["hub_n"][x] - lost + new + np.minimum(rows["hidden"][x], rows["hidden"][y])
        can = (rows["hub"][x] != rows["hub"][y]) | (DENOMINATOR * shared >= NUMERATOR * (n[x] + n[y] - shared))
        a_out.append(np.maximum(rows["id"][x[can]], rows["id"][y[can]]))
        b_out.append(np.minimum(rows["id"][x[can]], rows["id"][y[can]]))
    return np.concatenate(a_out), np.concatenate(b_out)


def compared(open_rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that may be links, among the rows of each key.

    Keys of more than ``BUCKET`` rows are dealt into blocks by hash, each pair of blocks to a task
    of its own, so no task holds more than a few blocks.  A row of a key of n is sent to n / ``BUCKET``
    of these, which costs less than the comparisons there.  Only pairs that may be links leave it.
    """
    sizes = open_rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BUCKET))).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = open_rows.join(cut(sizes, "sizes"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).select(*_OPEN)
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {}
            for name, column in zip(_OPEN, batch.columns, strict=True):
                wide = name in ("sketch", "lost", "novel")
                rows[name] = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1) if wide else column.to_numpy(zero_copy_only=False)
            if kept is not None:
                rows = {k: np.concatenate([kept[k], v]) for k, v in rows.items()}
            new = (np.diff(rows["key"]) != 0) | (np.diff(rows["p"]) != 0) | (np.diff(rows["q"]) != 0)
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if stop - start > 1:
                    a, b = _candidates({k: v[start:stop] for k, v in rows.items()})
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            kept = {k: v[starts[-1] :] for k, v in rows.items()}
        if kept is not None and len(kept["id"]) > 1:
            a, b = _candidates(kept)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return placed.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, out).distinct()


def _marks(shingles: np.ndarray) -> np.ndarray:
    out = np.zeros(MARKS // 64, np.uint64)
    place = _mix(shingles) % np.uint64(MARKS)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


_CHECKED = T.StructType(
    [
        T.StructField("a", T.LongType()),
        T.StructField("b", T.LongType()),
        T.StructField("linked", T.BooleanType()),
        T.StructField("hub_n", T.LongType()),
        T.StructField("lost", T.ArrayType(T.LongType())),
        T.StructField("novel", T.ArrayType(T.LongType())),
        T.StructField("hidden", T.LongType()),
    ]
)


def _against_hub(met: DataFrame) -> DataFrame:
    """For (a, b, x, y), with b the hub: whether the sets link, and a's bit sets against the hub."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ends = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, (a, b) in enumerate(zip(*ends, strict=True)):
                    x, y = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (2, 3))
                    novel, lost = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
                    both = len(x) - len(novel)
                    new = _marks(novel)
                    hidden = len(novel) - sum(int(v).bit_count() for v in new)
                    linked = DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)
                    yield a, b, linked, len(y), _marks(lost).view(np.int64).tolist(), new.view(np.int64).tolist(), hidden

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), _CHECKED)

    return met.select("a", "b", "x", "y").mapInArrow(run, _CHECKED)


def with_sets(pairs: DataFrame, docs: DataFrame, text: str, key: str, repeats: bool) -> DataFrame:
    """(a, b, x, y): the pairs with the full sets of their ends.  Only the texts of these are read into sets; ``repeats`` says whether ids do."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bodies = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("body")).join(ends, "id", "left_semi")
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in W.chunks(whole):
                    sets = shingle_sets(batch.column(1))
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "shingles"])

    sets = cut(bodies.mapInArrow(run, out).dropDuplicates(["id"]) if repeats else bodies.mapInArrow(run, out), "sets", gather=True)
    return pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")


def confirm(pairs: DataFrame, docs: DataFrame, text: str, key: str, repeats: bool) -> DataFrame:
    """The pairs (a, b) whose full sets pass the threshold."""
    met = with_sets(pairs, docs, text, key, repeats).withColumn("both", F.size(F.array_intersect("x", "y")))
    return met.filter(f"{DENOMINATOR} * both >= {NUMERATOR} * (size(x) + size(y) - both)").select("a", "b")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of ``docs``.

    A row without words, or with a null text, is linked with nothing.  A row with a null id can't
    be named by a component: it is linked with nothing, has a null component and is kept.  Ids
    are expected to be unique: rows that share one are linked through it, and of their different
    texts one is compared with other documents.  An empty table gives no rows; other columns are left.
    """
    signed = cut(signatures(docs, text, key), "signatures", gather=True)
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    repeats = not usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    # written out, as both sides of a join can only be split where a key is hot if neither is still being grouped
    groups = cut(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "groups")
    named = usable.join(groups, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("id"), "sketch", "signature")
    # rows without a digest don't meet under the null one
    others = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("id"), "sketch", F.lit(None).cast("binary").alias("signature"))
    member = cut(named.unionByName(others).withColumn("signature", F.when(F.col("doc_id") == F.col("id"), F.col("signature"))), "members", gather=True)
    nodes = member.filter("signature is not null").select("id", F.col("n_shingles").alias("n"), "sketch", "signature")
    nodes = nodes.dropDuplicates(["id"]) if repeats else nodes
    keyed = chunk_keys(nodes)
    hubs = cut(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub <> last").select("key", "hub"), "hubs", gather=True)
    buckets = cut(keyed.join(hubs, "key"), "buckets", gather=True)
    narrow = nodes.select("id", "n", "sketch")
    met = buckets.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    x, y = narrow.withColumnRenamed("id", "a"), narrow.withColumnRenamed("id", "b")
    near = met.alias("p").join(x.alias("x"), "a").join(y.alias("y"), "b").filter(_near("x", "y"))
    first = cut(near.groupBy("a").agg(F.min("b").alias("b")), "first")
    checked = cut(_against_hub(with_sets(first, docs, text, key, repeats)), "checked", gather=True)
    links = checked.filter("linked").select("a", "b")
    if repeats:
        links = links.unionByName(member.filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    parts = cut(components(links), "components")

    known = buckets.select("key", "id").join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    open_keys = cut(known.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key"), "open_keys")
    zero = F.array_repeat(F.lit(0).cast("long"), MARKS // 64)
    marks = checked.select(F.col("a").alias("id"), F.col("b").alias("hub"), "hub_n", "lost", "novel", "hidden")
    about = narrow.join(marks, "id", "left").select(
        "id", "n", "sketch", F.coalesce("hub", "id").alias("hub"), F.coalesce("hub_n", "n").alias("hub_n"), F.coalesce("lost", zero).alias("lost"), F.coalesce("novel", zero).alias("novel"), F.coalesce("hidden", F.lit(0)).alias("hidden")
    )
    rest = cut(known.join(open_keys, "key").join(about, "id"), "open")
    pairs = compared(rest).join(first, ["a", "b"], "left_anti")
    more = cut(pairs, "pairs")
    if not more.isEmpty():
        added = cut(confirm(more, docs, text, key, repeats), "links", gather=True)
        parts = components(links.unionByName(added))

    out = member.select("doc_id", "n_shingles", "id").join(parts, "id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, the one with the smallest id.

    Where an id is null or repeats, all rows are told apart by their place in the table instead
    of their ids, so unlike texts under one id, or under none, stay.  Rows without words stay.
    """
    unnamed = docs.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or k is null")
    if unnamed.isEmpty():
        gone = near_duplicates(docs, text, key).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
    mark = next(m for m in ("_mark" + "_" * i for i in range(len(docs.columns) + 1)) if m not in docs.columns)
    placed = cut(docs.withColumn(mark, F.monotonically_increasing_id()), "marked")
    gone = near_duplicates(placed, text, mark).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return placed.join(gone, placed[mark] == gone["_gone"], "left_anti").drop(mark)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component; ``near_duplicates`` states nulls, empty texts, repeats and empty tables."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every pair of documents that share a shingle, so for small tables.
ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (
  select distinct doc_id, unnest(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: md5_number(list_aggregate(words[i:i + 4], 'string_agg', ' ')))
    when len(words) > 0 then [md5_number(list_aggregate(words, 'string_agg', ' '))] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
near(a, b) as (
  select a, b from link union select b, a from link
  union
  select near.a, l.b from near join (select a, b from link union all select b, a from link) l on near.b = l.a)
select doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(doc_id, coalesce(c, doc_id)) as component_id, least(doc_id, coalesce(c, doc_id)) = doc_id as kept
from documents left join n using (doc_id) left join (select a as doc_id, min(b) as c from near group by a) using (doc_id)
"""
