"""The prefix trie of conversations, by an LCP-aware external mergesort.

A conversation is the sequence of its turns' digests (SHA-256 of role and text) and their texts'
sizes; texts go no further.  Spark deals the sequences into ranges, by sequence and id, so copies
of one conversation, and all that follow one first turn, spread over as many ranges as they need.
A range is written out with the last sequence before it and the first one behind it.

Within a range each Arrow batch becomes a sorted run, whose entries carry the number of turns
that they share with the entry before (LCP).  A loser tree merges the runs: of two heads the one
that shares more turns with the last one out comes first, and only on equal numbers are turns
compared, from there on.  So no turn is compared again that is known to be shared.  The merged
stream keeps the open path as a stack: where the next sequence leaves it, nodes are finished.

A node's facts are sums over its members and known turns shared with the neighbours: a node is
new where it is deeper than the LCP, a member ends a leaf where the next one does not go on from
it, and each member behind a node's first saves its text once.  So a node that lies in several
ranges is the sum of its parts.  Such nodes are on the first or last path of a range; only they,
and their children's parents, are joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .periodic_runs import CRC32
from .shared import batches_out, cut, table

#: Bytes of a turn's digest.
WIDE = 32
#: Characters of one piece of a list of members that lies in several ranges.
PIECE = 1 << 16
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def paths(turns: DataFrame) -> DataFrame:
    """conv_id and ``steps`` (turn, digest, size) of each conversation of ``turns`` (conv_id, turn, role, text; other columns are left).

    A conversation's rows are ordered by turn, nulls first, ties by their digest, and all of them
    are turns, repeated ones too.  Null roles and texts count as empty.  A row without a conv_id
    belongs to no conversation and is left out.  A conversation is one row of about 50 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    step = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).alias("size"))
    return turns.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(step)).alias("steps"))


def rebuilt(of: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the conversation whose id is the next multiple of five towards zero, as the hash of its id says."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    own = of.select("conv_id", "steps", h.alias("_h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("_base"))
    base = of.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("_base"), F.slice("steps", 1, 8).alias("_first"))
    none = F.array().cast(of.schema["steps"].dataType)
    taken = F.coalesce(F.slice("_first", F.lit(1), F.col("_h")), none)
    left = F.slice("steps", F.col("_h") + 1, F.greatest(F.size("steps") - F.col("_h"), F.lit(0)))
    return own.join(base, "_base", "left").select("conv_id", F.concat(taken, left).alias("steps"))


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two sequences share at their start, of which ``known`` are known to be."""
    most, n = min(len(a), len(b)) // WIDE, known
    while n < most and a[n * WIDE : (n + 1) * WIDE] == b[n * WIDE : (n + 1) * WIDE]:
        n += 1
    return n


@dataclass
class Run:
    """Sorted sequences with their ids, sizes, and the turns shared with the one before."""

    rows: list[tuple[bytes, int, list[int]]]
    lcps: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rows.sort(key=lambda r: r[:2])
        self.lcps = [0, *(shared(a[0], b[0]) for a, b in zip(self.rows[:-1], self.rows[1:], strict=True))]


class LoserTree:
    """Merges runs: yields (sequence, id, sizes, turns shared with the one before)."""

    def __init__(self, runs: list[Run]):
        self.runs = [r for r in runs if r.rows]
        self.at = [0] * len(self.runs)
        # turns that a run's head shares with the last one out
        self.lcp = [0] * len(self.runs)
        self.compared = 0
        size = 1
        while size < len(self.runs):
            size *= 2
        self.size = size
        self.losers = [-1] * size
        best = [r if r < len(self.runs) else -1 for r in range(size)]
        level = size
        while level > 1:
            level //= 2
            up = []
            for i in range(level):
                won, lost = self._play(best[2 * i], best[2 * i + 1])
                self.losers[level + i] = lost
                up.append(won)
            best = up
        self.winner = best[0] if self.runs else -1

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; -1 is a run that has ended."""
        if a < 0 or b < 0:
            return max(a, b), -1
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        x, y = self.runs[a].rows[self.at[a]], self.runs[b].rows[self.at[b]]
        n = shared(x[0], y[0], self.lcp[a])
        self.compared += n - self.lcp[a] + 1
        won, lost = (a, b) if (x[0][n * WIDE : (n + 1) * WIDE], x[1]) <= (y[0][n * WIDE : (n + 1) * WIDE], y[1]) else (b, a)
        self.lcp[lost] = n
        return won, lost

    def __iter__(self) -> Iterator[tuple[bytes, int, list[int], int]]:
        while self.winner >= 0:
            w = self.winner
            run = self.runs[w]
            yield (*run.rows[self.at[w]], self.lcp[w])
            self.at[w] += 1
            now = w
            if self.at[w] < len(run.rows):
                self.lcp[w] = run.lcps[self.at[w]]
            else:
                now = -1
            place = (w + self.size) // 2
            while place >= 1:
                now, self.losers[place] = self._play(now, self.losers[place])
                place //= 2
            self.winner = now


class _Node:
    """A node of the open path."""

    __slots__ = ("name", "place", "depth", "size", "new", "split", "ends", "convs", "children", "leaves", "saved", "hash", "text", "piece")

    def __init__(self, name: bytes, place: int, depth: int, size: int, new: bool, split: bool):
        self.name, self.place, self.depth, self.size, self.new, self.split = name, place, depth, size, new, split
        self.ends = self.convs = self.children = self.leaves = self.saved = self.piece = 0
        self.hash = hashlib.sha256()
        self.text: list[str] = []


#: A finished node, one whose parent lies in several ranges, a part of a node that does, and a piece of such a node's members.
DONE, CHILD, PART, ENDS = range(4)
_OUT = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("parent", T.BinaryType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("piece", T.LongType()),
        *(T.StructField(c, T.LongType()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
        T.StructField("ends", T.StringType()),
    ]
)


def _least(merged: list[tuple[bytes, int, list[int], int]]) -> list[int]:
    """The smallest member of each node, by the order in which nodes are opened."""
    least: list[int] = []
    open_at: list[int] = []
    for i, (path, conv_id, _, lcp) in enumerate(merged):
        keep = lcp + 1 if i else 0
        while len(open_at) > keep:
            top = open_at.pop()
            if open_at:
                least[open_at[-1]] = min(least[open_at[-1]], least[top])
        for _ in range(len(open_at), len(path) // WIDE + 1):
            open_at.append(len(least))
            least.append(conv_id)
        least[open_at[-1]] = min(least[open_at[-1]], conv_id)
    while len(open_at) > 1:
        top = open_at.pop()
        least[open_at[-1]] = min(least[open_at[-1]], least[top])
    return least


def finished(part: int, runs: list[Run], before: bytes | None, behind: bytes | None) -> Iterator[tuple]:
    """Rows of ``_OUT`` for one range, between the last sequence before it and the first one behind it."""
    merged = list(LoserTree(runs))
    if not merged:
        return
    least = _least(merged)
    first, last = merged[0][0], merged[-1][0]
    # nodes of the first and last path down to these depths lie in other ranges too
    left = shared(before, first) if before is not None else -1
    right = shared(last, behind) if behind is not None else -1
    stack: list[_Node] = []
    opened = 0

    def close() -> Iterator[tuple]:
        node = stack.pop()
        above = stack[-1] if stack else None
        node.convs += node.ends
        node.saved += (node.convs - node.new) * node.size
        if above is not None:
            above.convs += node.convs
            above.leaves += node.leaves
            above.saved += node.saved
        facts = (node.convs, node.children, node.leaves, node.saved)
        up, up_id = (None, None) if above is None else (above.name, least[above.place])
        if node.split:
            if node.text:
                yield ENDS, node.name, None, part, node.piece, *[None] * 7, ",".join(node.text)
            yield PART, node.name, up, part, None, least[node.place], node.depth, None, *facts, None
        elif above is not None and above.split:
            yield CHILD, node.name, up, part, None, least[node.place], node.depth, None, *facts, node.hash.hexdigest()
        else:
            yield DONE, node.name, up, part, None, least[node.place], node.depth, up_id, *facts, node.hash.hexdigest()

    for i, (path, conv_id, sizes, lcp) in enumerate(merged):
        lcp = lcp if i else left
        while stack and len(stack) > lcp + 1:
            yield from close()
        for depth in range(len(stack), len(sizes) + 1):
            up = stack[-1] if stack else None
            digest = path[(depth - 1) * WIDE : depth * WIDE] if depth else b""
            name = hashlib.sha256(up.name + digest).digest()[:16] if up else b"\0" * 16
            new = depth > lcp
            split = (i == 0 and depth <= left) or (depth <= right and path[: depth * WIDE] == last[: depth * WIDE])
            stack.append(_Node(name, opened, depth, sizes[depth - 1] if depth else 0, new, split))
            opened += 1
            if new and up:
                up.children += 1
        node = stack[-1]
        if node.split:
            node.text.append(str(conv_id))
            if 8 * len(node.text) >= PIECE:
                yield ENDS, node.name, None, part, node.piece, *[None] * 7, ",".join(node.text)
                node.text, node.piece = [], node.piece + 1
        else:
            node.hash.update(b",%d" % conv_id if node.ends else b"%d" % conv_id)
        node.ends += 1
        goes_on = merged[i + 1][3] if i + 1 < len(merged) else right
        node.leaves += goes_on < len(sizes)
    while stack:
        yield from close()


_RANGE = ("part", "kind", "conv_id", "path", "sizes")


def _ranges(of: DataFrame) -> DataFrame:
    """(part, kind, conv_id, path, sizes): sequences by range, and in each range its neighbours' (kind -1 before it, 1 behind it)."""
    flat = of.select("conv_id", F.array_join(F.transform("steps", lambda s: F.hex(s["digest"])), "").alias("path"), F.transform("steps", lambda s: s["size"].cast("long")).alias("sizes"))
    dealt = cut(flat.repartitionByRange("path", "conv_id").withColumn("part", F.spark_partition_id()), "ranges")
    # a row for each range, so these windows hold no more than there are tasks
    bounds = dealt.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    order = Window.orderBy("part")
    ends = bounds.withColumns({"before": F.lag("high").over(order), "behind": F.lead("low").over(order)})
    marks = ends.select("part", F.explode(F.array(F.struct(F.lit(-1).alias("kind"), F.col("before").alias("path")), F.struct(F.lit(1).alias("kind"), F.col("behind").alias("path")))).alias("m")).filter("m.path is not null")
    marks = marks.select("part", "m.kind", F.lit(None).cast("long").alias("conv_id"), "m.path", F.array().cast("array<long>").alias("sizes"))
    return dealt.select("part", F.lit(0).alias("kind"), "conv_id", "path", "sizes").unionByName(marks)


def nodes(of: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of the conversations of ``paths``.

    node and parent (digests of the sequences), conv_id (smallest member), depth, parent_conv_id,
    n_convs (members), n_children, n_leaves (childless nodes in the subtree), saved_tokens (bytes of
    text that members beyond each node's first need not repeat, over the subtree) and ends_sha256
    (of the ids, ascending, of members that end here).  A subtree includes its top.  Copies of a
    conversation are members of the same nodes; conversations without turns are members of the
    root alone.  No conversations give no rows, not even a root.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, runs, sides = None, [], {}
        for batch in batches:
            parts = batch.column(0).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1]).tolist() if len(parts) else []
            for start, stop in zip(starts, [*starts[1:], len(parts)], strict=True):
                if part is not None and parts[start] != part:
                    yield from finished(part, runs, sides.get(-1), sides.get(1))
                    runs, sides = [], {}
                part = int(parts[start])
                own = []
                for kind, conv_id, path, sizes in zip(*(batch.column(c).slice(start, stop - start).to_pylist() for c in range(1, 5)), strict=True):
                    if kind:
                        sides[kind] = bytes.fromhex(path)
                    else:
                        own.append((bytes.fromhex(path), conv_id, sizes))
                runs.append(Run(own))
        if part is not None:
            yield from finished(part, runs, sides.get(-1), sides.get(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), _OUT, lambda r: 100 + len(r[-1] or ""))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """SHA-256 of each node's pieces, which come in order and need not be held together."""

        def each() -> Iterator[tuple]:
            name, so_far = None, None
            for batch in batches:
                for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if node == name:
                        so_far.update(b"," + text.encode())
                        continue
                    if so_far is not None:
                        yield name, so_far.hexdigest()
                    name, so_far = node, hashlib.sha256(text.encode())
            if so_far is not None:
                yield name, so_far.hexdigest()

        return batches_out(each(), sums)

    sums = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("ends_sha256", T.StringType())])
    made = cut(_ranges(of).repartition("part").sortWithinPartitions("part").mapInArrow(run, _OUT), "nodes")
    facts = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    pieces = made.filter(F.col("kind") == ENDS).repartition("node").sortWithinPartitions("node", "part", "piece").select("node", "ends").mapInArrow(hashed, sums)
    whole = made.filter(F.col("kind") == PART).groupBy("node").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *[F.sum(c).alias(c) for c in facts])
    whole = cut(whole.join(pieces, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_MEMBERS))), "split_nodes")
    above = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = made.filter(F.col("kind") == CHILD).withColumnRenamed("ends", "ends_sha256").select(*whole.columns)
    done = made.filter(F.col("kind") == DONE).withColumnRenamed("ends", "ends_sha256").select(*whole.columns, "parent_conv_id")
    return done.unionByName(whole.unionByName(below).join(above, "parent", "left"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the rebuilt conversations' trie; ``paths`` and ``nodes`` state nulls, ties, repeats and empty tables."""
    of = rebuilt(paths(table(spark, sf_dir, "conversations")))
    return nodes(of).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE = (
    """
with recursive o as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
ids as (select *, """
    + CRC32.format("c")
    + """ % 9 as h, c - c % 5 as b from (select c, count(*) as n from o group by c)),
r as (select ids.c, pos, role, text from ids join o on o.c = ids.b where pos < h
  union all select ids.c, pos - ids.h + least(ids.h, coalesce(base.n, 0)), role, text from ids join o on o.c = ids.c left join ids base on base.c = ids.b where pos >= ids.h),
l as (select c, list(md5(strlen(role) || ':' || role || text) || ':' || strlen(text) order by pos) as k from r group by c),
w as (select ids.c, coalesce(k, []) as k from ids left join l using (c)),
p as (select c, len(k) as n, k[1:d] as k, d from (select c, k, unnest(range(0, len(k) + 1)) as d from w)),
node as (select k, d, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(c, ',' order by c) filter (n = d), '') as ends, case when d > 0 then cast(string_split(k[d], ':')[2] as bigint) else 0 end as size from p group by k, d),
kids as (select k[1:d - 1] as k, count(*) as n_children from node where d > 0 group by all),
up as (select k[1:j] as k, sum((n_convs - 1) * size) as saved, count(*) filter (n_children is null) as leaves
  from (select k, unnest(range(0, d + 1)) as j, n_convs, size, n_children from node left join kids using (k)) group by all)
select node.conv_id, node.d as depth, above.conv_id as parent_conv_id, node.n_convs, coalesce(n_children, 0) as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, sha256(node.ends) as ends_sha256
from node left join kids using (k) join up using (k) left join node above on node.d > 0 and above.k = node.k[1:node.d - 1]
"""
)
