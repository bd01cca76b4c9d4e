"""Jaccard join on word n-grams, as a blocked sparse product of the document by n-gram incidence with itself.

Texts with equal sets of n-grams are one row of the incidence matrix, which has a weight.  Two rows
link when their overlap is at least ``NUMERATOR`` hundredths of their union, so a linked row shares
that part of its own n-grams at least.  All bounds follow from this and lose no link:

1. The columns are dealt into blocks by hash.  A block tells each row how many of its n-grams another
   row has too; a row that shares fewer than its size asks for can't link and goes.  Before that,
   a task merges what its own rows share, so a block hears of a frequent n-gram once for each task's
   share of texts, not once for each text.
2. Among the rows left, n-grams are ordered from rare to frequent.  A link shares an n-gram among
   the first ``n - needed + 1`` of each end, so rows that meet under none of these can't link.
   Those that do, directly or over others, form areas.
3. The rows are sorted by area, then size, and cut into blocks of bounded rows and n-grams.  Two
   blocks are multiplied where an area lies in both and their sizes leave a link possible.
   Overlaps are accumulated column by column: sparsely for rare n-grams, as a dense product for those that
   many rows of both blocks have.  Pairs below the bound of their two sizes are dropped there; what
   leaves a block is, for each row, its number of links and a row that it is connected with.

A group of k near copies so costs (k / ``ROWS``) ** 2 products of bounded size in as many tasks; its pairs
are counted, never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .components import components
from .shared import batches_out, cut, table

N = 4
NUMERATOR, DENOMINATOR = 85, 100
#: N-grams of a column block, about.
BLOCK_GRAMS = 1 << 21
#: Most rows and, but for a single larger row, n-grams of a row block.
ROWS, GRAMS = 1024, 1 << 19
#: Columns of a dense product at once, and pairs of a sparse one.
DENSE, SPARSE = 1024, 1 << 20
#: A column is dense where a row of one block meets more than this share of the other's.
DENSE_SHARE = 1 / 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Stands for several rows that a task has merged.
_MANY = np.iinfo(np.int64).min


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Each text's sorted distinct n-grams as 64-bit fingerprints; a text with fewer words has one of them all, one without words none."""
    found = W.split(texts)
    with np.errstate(over="ignore"):
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.distinct), np.uint64, len(found.distinct))[found.codes]
        rolled = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for k in range(n):
            rolled = rolled * _BASE + h[k : len(h) - n + 1 + k] if len(h) >= n else rolled
        rolled = _mix(rolled)
        ends, out = found.offsets.tolist(), []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a >= n:
                out.append(np.unique(rolled[a : b - n + 1]))
            elif b > a:
                x = np.array([b - a], np.uint64)
                for v in h[a:b]:
                    x = x * _BASE + v
                out.append(_mix(x ^ _BASE))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


_SIGNED = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "n", "d1", "d2")])


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([[xxhash.xxh3_64_intdigest(s.tobytes(), seed) for seed in (1, 2)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)


def signed(docs: DataFrame, text: str) -> DataFrame:
    """row, set size, and a 128-bit digest of the set (null for an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.chunks(whole):
                sets = gram_sets(batch.column(1))
                n, digests = np.array([len(s) for s in sets], np.int64), _digests(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *(pa.array(digests[:, i], mask=n == 0) for i in (0, 1))], names=_SIGNED.names)

    return docs.select("row", text).mapInArrow(run, _SIGNED)


_DEALT = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("grams", T.BinaryType()), T.StructField("owners", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_SHARE = T.StructType([T.StructField("d1", T.LongType()), T.StructField("shared", T.LongType())])


def _deal(sets: list[np.ndarray], owners: np.ndarray, blocks: int) -> Iterator[tuple]:
    """(block, n-grams' remainders, their rows, n-grams of each row) for each column block, and as block -1 the n-grams that rows here share."""
    many = len(sets)
    grams = np.concatenate([*sets, np.zeros(0, np.uint64)])
    own = np.repeat(np.arange(many), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, own = grams[order], own[order]
    first = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, bool)
    size = np.diff(np.concatenate([np.flatnonzero(first), [len(grams)]]))
    merged = np.repeat(size > 1, size)
    met = np.bincount(own[merged], minlength=many)
    at = np.flatnonzero(met)
    if len(at):
        yield -1, b"", owners[at].tobytes(), met[at].astype("<u4").tobytes()
    grams, own = grams[first], np.where(merged, many, own)[first]
    block = (grams % np.uint64(blocks)).astype(np.int64)
    rest = ((grams // np.uint64(blocks)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    order = np.lexsort((own, block))
    block, own, rest = block[order], own[order], rest[order]
    heads = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (own[1:] != own[:-1])])) if len(block) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([heads, [len(block)]])).astype("<u4")
    names = np.concatenate([owners, [_MANY]])[own[heads]]
    cuts = np.searchsorted(block[heads], np.arange(blocks + 1))
    ends = np.concatenate([heads, [len(block)]])
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        i, j = cuts[b], cuts[b + 1]
        yield b, rest[ends[i] : ends[j]].tobytes(), names[i:j].tobytes(), counts[i:j].tobytes()


def _met(grams: list[bytes], owners: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and how many of a column block's n-grams each shares with another row."""
    g = np.frombuffer(b"".join(grams), "<u4")
    own = np.repeat(np.frombuffer(b"".join(owners), "<i8"), np.frombuffer(b"".join(counts), "<u4"))
    order = np.lexsort((own, g))
    g, own = g[order], own[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (own[1:] != own[:-1])])
    g, own = g[new], own[new]
    size = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), [len(g)]]))
    return np.unique(own[np.repeat(size > 1, size) & (own != _MANY)], return_counts=True)


def sharing(docs: DataFrame, text: str, blocks: int) -> DataFrame:
    """(d1, shared): for each set, by its digest, an upper bound of its n-grams that other sets have too."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for whole in batches:
                for batch in W.chunks(whole, 0):
                    sets = [s for s in gram_sets(batch.column(0)) if len(s)]
                    owners, at = np.unique(_digests(sets)[:, 0], return_index=True)
                    yield from _deal([sets[i] for i in at], owners, blocks)

        return batches_out(rows(), _DEALT, lambda r: len(r[1]) + len(r[2]) + len(r[3]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, [[], [], []]
        for batch in batches:
            for block, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block == -1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(parts[1], "<i8")), pa.array(np.frombuffer(parts[2], "<u4").astype(np.int64))], names=_SHARE.names)
                    continue
                if block != now and kept[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _met(*kept)], names=_SHARE.names)
                    kept = [[], [], []]
                now = block
                for whole, part in zip(kept, parts, strict=True):
                    whole.append(part)
        if kept[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _met(*kept)], names=_SHARE.names)

    # what rows share within a task's texts is summed where it is, but for the deal of its block -1 by digest
    dealt = docs.select(text).mapInArrow(deal, _DEALT)
    spread = F.when(F.col("block") == -1, F.xxhash64("owners")).otherwise(F.col("block"))
    return dealt.repartition(spread).sortWithinPartitions("block").mapInArrow(meet, _SHARE).groupBy("d1").agg(F.sum("shared").alias("shared"))


def _needed(n: str) -> str:
    """N-grams that a row of ``n`` shares with any that it links with."""
    return f"ceil({NUMERATOR} * {n} / {DENOMINATOR}.0)"


def incidence(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(id, n, w, grams): the sets of the given rows (id, w)."""
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("w", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.chunks(whole, 2):
                sets = gram_sets(batch.column(2))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=out.names)

    return docs.join(rows, docs["row"] == rows["id"]).select("id", "w", text).mapInArrow(run, out)


def areas(sets: DataFrame) -> DataFrame:
    """(id, area) of the rows that meet another one under an n-gram among their rarest; no link leaves an area."""
    each = sets.select("id", "n", F.explode("grams").alias("gram"))
    # written out, so that the join with it can split a frequent n-gram
    often = cut(each.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "frequencies", gather=True)
    ranked = each.join(often, "gram").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("rare"))
    # n-grams that no other row has come before all these
    first = F.expr(f"greatest(cast(size(rare) - {_needed('n')} + 1 as int), 0)")
    keys = cut(ranked.select("id", F.explode(F.slice("rare", F.lit(1), first)).alias("k")).select("id", "k.gram"), "keys", gather=True)
    hubs = cut(keys.groupBy("gram").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub <> last").select("gram", "hub"), "hubs", gather=True)
    met = keys.join(hubs, "gram").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    return components(met).withColumnRenamed("component", "area")


def blocks(sets: DataFrame, area: DataFrame) -> DataFrame:
    """(id, p, q, side): each row's block p, or q, for every product of two blocks that it takes part in."""
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "n", "area", "block")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, rows, grams = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            placed = []
            for n in batch.column(1).to_pylist():
                if rows and (rows == ROWS or grams + n > GRAMS):
                    block, rows, grams = block + 1, 0, 0
                rows, grams = rows + 1, grams + n
                placed.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(placed, pa.int64())], names=out.names)

    sized = sets.select("id", "n").join(area, "id").select("id", "n", "area")
    dealt = cut(sized.repartitionByRange("area", "n", "id").sortWithinPartitions("area", "n", "id").mapInArrow(run, out), "blocks")
    spans = cut(dealt.groupBy("area", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")), "spans")
    p, q = spans.select("area", F.col("block").alias("p"), F.col("high")), spans.select("area", F.col("block").alias("q"), F.col("low"))
    # blocks of an area rise with its rows' sizes
    pairs = p.join(q, "area").filter(f"p <= q and {DENOMINATOR} * high >= {NUMERATOR} * low").select("area", "p", "q")
    sides = pairs.select("area", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"), "p", "q")
    return dealt.join(cut(sides, "sides"), ["area", "block"]).select("id", "p", "q", (F.col("block") == F.col("q")).alias("side"))


def _by_row(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*lists, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The overlaps of all rows of two blocks, by columns that both have."""
    (g, i), (h, j) = _by_row(left), _by_row(right)
    both = np.intersect1d(g, h)
    c, d = np.searchsorted(both, g), np.searchsorted(both, h)
    in_g = both[np.minimum(c, len(both) - 1)] == g if len(both) else np.zeros(len(g), bool)
    in_h = both[np.minimum(d, len(both) - 1)] == h if len(both) else np.zeros(len(h), bool)
    c, i, d, j = c[in_g], i[in_g], d[in_h], j[in_h]
    n_left, n_right = np.bincount(c, minlength=len(both)), np.bincount(d, minlength=len(both))
    out = np.zeros((len(left), len(right)), np.int32)
    dense = n_left * n_right > DENSE_SHARE * len(left) * len(right)
    heavy = np.flatnonzero(dense)
    place = np.cumsum(dense) - 1
    for at in range(0, len(heavy), DENSE):
        x, y = (np.zeros((len(rows), min(DENSE, len(heavy) - at)), np.float32) for rows in (left, right))
        for block, col, row in ((x, c, i), (y, d, j)):
            here = dense[col] & (place[col] >= at) & (place[col] < at + DENSE)
            block[row[here], place[col[here]] - at] = 1
        out += (x @ y.T).astype(np.int32)
    light = np.flatnonzero(~dense)
    if len(light):
        by_c, by_d = np.argsort(c, kind="stable"), np.argsort(d, kind="stable")
        first, other = np.concatenate([[0], np.cumsum(n_left)]), np.concatenate([[0], np.cumsum(n_right)])
        flat = out.ravel()
        work = np.cumsum(n_left[light] * n_right[light])
        for part in np.split(light, np.searchsorted(work, np.arange(SPARSE, int(work[-1]) + 1, SPARSE)) if len(work) else []):
            # each row of a column on the left meets all rows of it on the right
            reps = n_right[part].repeat(n_left[part])
            x = np.repeat(i[by_c][W.gather(np.arange(len(c)), first[part], n_left[part])], reps)
            y = j[by_d][W.gather(np.arange(len(d)), np.repeat(other[part], n_left[part]), reps)]
            np.add.at(flat, x * len(right) + y, 1)
    return out


_LINKED = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "links", "to")])


def _links(ids: list[np.ndarray], weights: list[np.ndarray], sets: list[list[np.ndarray]]) -> pa.RecordBatch | None:
    """id, weight of the rows linked with it, and a row of its connected rows here, of one block with itself or of two blocks."""
    one = not len(ids[1])
    a, b = (0, 0) if one else (0, 1)
    over = product(sets[a], sets[b])
    n, m = (np.array([len(s) for s in sets[k]], np.int64) for k in (a, b))
    linked = DENOMINATOR * over >= NUMERATOR * (n[:, None] + m - over)
    if one:
        np.fill_diagonal(linked, False)
    x, y = np.nonzero(linked)
    if not len(x):
        return None
    names = ids[a] if one else np.concatenate(ids)
    y = y if one else y + len(ids[0])
    links = np.zeros(len(names), np.int64)
    np.add.at(links, x, weights[b][y - (0 if one else len(ids[0]))])
    if not one:
        np.add.at(links, y, weights[a][x])
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    at = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(links[at]), pa.array(names[root[at]])], names=_LINKED.names)


def linked(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, links, to) of every product of two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        ids, weights, grams = ([], []), ([], []), ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            one = now[0] == now[1]
            full = ids[1] if one else ids[0]
            if full and (one or ids[1]):
                names = [np.array(x, np.int64) for x in ((ids[1], []) if one else ids)]
                heavy = [np.array(x, np.int64) for x in ((weights[1], []) if one else weights)]
                made = _links(names, heavy, [grams[1], []] if one else list(grams))
                if made is not None:
                    yield made
            for held in (*ids, *weights, *grams):
                held.clear()

        for batch in batches:
            p, q, side, name, w = (batch.column(k).to_pylist() for k in range(5))
            lists = batch.column(5)
            values, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            for r in range(batch.num_rows):
                if now is not None and now != (p[r], q[r]):
                    yield from done()
                now = (p[r], q[r])
                s = int(side[r])
                ids[s].append(name[r])
                weights[s].append(w[r])
                grams[s].append(values[offsets[r] : offsets[r + 1]].copy())
        if now is not None:
            yield from done()

    met = placed.join(sets.select("id", "w", "grams"), "id").select("p", "q", "side", "id", "w", "grams")
    return met.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(run, _LINKED)


def similar(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links, itself included) and n_links, one row for each row of ``docs``.

    ``n_links`` counts the other rows that a row links with, those of equal sets included.  A null text, or one without
    words, has no n-grams and links with nothing.  Rows are told apart by their place, so keys may
    be of any type, null or repeated: a row with a null key is linked as others are, and has a
    null component only where no key is reachable.  An empty table gives no rows; other columns are left.
    """
    integral = isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    unique = integral and docs.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or k is null").isEmpty()
    given = docs.select(F.col(key).alias("name"), F.col(text).alias("body"))
    given = given.withColumn("row", F.col("name").cast("long")) if unique else cut(given.withColumn("row", F.monotonically_increasing_id()), "rows")
    # written out, as both sides of a join can only be split where a key is hot if neither is still being grouped
    signs = cut(signed(given, "body"), "signed", gather=True)
    named = signs.withColumn("name", F.col("row").cast(docs.schema[key].dataType)) if unique else signs.join(given.select("row", "name"), "row")
    classes = cut(named.filter("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("w"), F.min("name").alias("least")), "classes", gather=True)
    total = classes.agg(F.sum("n")).first()[0] or 0
    share = sharing(given, "body", max(16, -(-total // BLOCK_GRAMS)))
    usable = classes.join(share, "d1").filter(f"shared >= {_needed('n')}").select("id", "w")
    sets = cut(incidence(given, cut(usable, "usable"), "body"), "sets", gather=True)
    area = cut(areas(sets), "areas")
    found = cut(linked(blocks(sets, area), sets), "linked", gather=True)
    parts = cut(components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))), "components")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_links = cut(classes.join(parts, "id").join(counted, "id").select("d1", "d2", "component", "links", "least"), "of_links")
    least = cut(of_links.groupBy("component").agg(F.min("least").alias("lowest")), "lowest")
    of_links = of_links.join(least, "component").select("d1", "d2", "lowest", "links")
    facts = cut(classes.join(of_links, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("lowest", "least").alias("lowest"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")).filter("n_links > 0"), "facts", gather=True)
    out = named.join(facts, ["d1", "d2"], "left")
    return out.select(F.col("name").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n_links") > 0, F.col("lowest")).otherwise(F.col("name")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component and number of links; ``similar`` states nulls, empty texts, repeats and empty tables."""
    return similar(table(spark, sf_dir, "documents"))


#: Every pair of documents that share an n-gram, so for small tables.
ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (
  select distinct doc_id, unnest(case when len(words) >= 4 then list_transform(range(1, len(words) - 2), lambda i: md5_number(list_aggregate(words[i:i + 3], 'string_agg', ' ')))
    when len(words) > 0 then [md5_number(list_aggregate(words, 'string_agg', ' '))] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
both_ways as (select a, b from link union all select b, a from link),
near(a, b) as (select a, b from both_ways union select near.a, l.b from near join both_ways l on near.b = l.a),
deg as (select a as doc_id, count(*) as n_links from both_ways group by a)
select doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(doc_id, coalesce(c, doc_id)) as component_id, coalesce(n_links, 0) as n_links
from documents left join n using (doc_id) left join (select a as doc_id, min(b) as c from near group by a) using (doc_id) left join deg using (doc_id)
"""
