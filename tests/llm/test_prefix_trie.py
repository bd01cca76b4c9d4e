"""The trie against brute force, over few and many ranges."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import prefix_trie as P


def brute(conversations):
    """{(smallest member, depth): facts} from {conv_id: ((role, text), ...)}; a path's facts are unique."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in ids if conversations[c] == path)))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids.get(path, [])), sum(p not in kids for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def collected(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def conversations(seed, n):
    """Shared beginnings, copies, conversations that end within others, and one hot beginning and one hot copy."""
    r = random.Random(seed)
    out = {}
    for c in range(n):
        turns = [("user" if d % 2 == 0 else "assistant", f"é{r.choice('ab')}" * r.randint(1, 2)) for d in range(r.randint(1, 6))]
        if c % 3 == 0:
            turns = [("system", "the same first turn"), *turns]
        if c % 4 == 0:
            turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
        out[c * 7 % 1009 - 40] = tuple(turns)
    return out


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_nodes_equal_brute_force(spark, parts):
    given = conversations(parts, 400)
    rows = [(c, i, role, text) for c, turns in given.items() for i, (role, text) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
        assert collected(P.nodes(P.paths(turns))) == brute(given)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_merging_compares_no_turn_that_is_known_to_be_shared():
    r = random.Random(4)
    key = lambda x: hashlib.sha256(bytes([x])).digest()
    long = b"".join(key(0) for _ in range(500))
    rows = [(long + b"".join(key(r.randint(1, 3)) for _ in range(r.randint(0, 4))), i, []) for i in range(400)]
    tree = P.LoserTree([P.Run(rows[i : i + 50]) for i in range(0, 400, 50)])
    out = list(tree)
    assert [x[:2] for x in out] == sorted(x[:2] for x in rows)
    assert [x[3] for x in out[1:]] == [P.shared(a[0], b[0]) for a, b in zip(out[:-1], out[1:], strict=True)]
    # the long beginning is read once by each game of the tree's first round, never again
    assert tree.compared < 8 * 500 + 400 * 3 * 6


def test_rebuilt_conversations_equal_brute_force(spark):
    import zlib

    r = random.Random(9)
    rows = [(c, t if t else None, None if r.random() < 0.1 else "user", None if r.random() < 0.1 else f"t{r.randint(0, 3)}") for c in (-7, -5, 0, 1, 2, 4, 5, 6, 11, 13, 15, 17, 20, 21, 22, 23, 24) for t in range(r.randint(1, 11))]
    own = {}
    for c, _, role, text in rows:
        own.setdefault(c, []).append((role or "", text or ""))
    want = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, int(c / 5) * 5
        want[c] = tuple(own.get(base, [])[:h] + turns[h:])
    assert any(not t for t in want.values())
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert collected(P.nodes(P.rebuilt(P.paths(turns)))) == brute(want)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 0, "user", "lost"), (2, None, "", ""), (3, 5, "user", "y" * 200_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "'p' as path", "2 as part")
    assert collected(P.nodes(P.paths(turns))) == brute({1: (("", ""), ("user", "x"), ("user", "x")), 2: (("", ""),), 3: (("user", "y" * 200_000),)})
    assert P.nodes(P.paths(turns.limit(0))).count() == 0
    alone = P.paths(turns.filter("conv_id = 2")).withColumn("steps", F.slice("steps", 1, 0))
    assert collected(P.nodes(alone)) == brute({2: ()})
