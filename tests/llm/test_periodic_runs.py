"""Periodic runs against brute force over every stretch and period."""

import hashlib
import random
import re
import zlib

import numpy as np
from tables import TESTDATA

from driftline.llm import periodic_runs as P


def brute(words):
    """Every maximal stretch of every period, the smallest period of each."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q):
                best.setdefault((i, length), q)
            i = j
    return sorted((s, length, q) for (s, length), q in best.items())


def sample(r):
    kind = r.randint(0, 4)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randint(0, 120))]
    unit = [r.choice("abcdefgh") for _ in range(r.randint(1, 40))]
    looped = unit * r.randint(1, 9)
    out = [r.choice("abcxyz") for _ in range(r.randint(0, 30))] + looped[: r.randint(0, len(looped))] + [r.choice("abcxyz") for _ in range(r.randint(0, 30))]
    if kind == 2:
        out = out * 2
    if kind == 3 and out:
        out[r.randrange(len(out))] = "!"
    return out


def test_runs_equal_brute_force():
    r = random.Random(12)
    for _ in range(500):
        words = sample(r)
        numbers = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, np.int64)
        found = P.runs(numbers)
        assert found == [tuple(x) for x in sorted(brute(words), key=lambda x: (x[0], x[2]))]
        gone = P.repeated(found, len(words))
        assert gone.tolist() == [any(s + q <= i < s + n for s, n, q in found) for i in range(len(words))]


def test_one_word_again_and_again_is_one_run():
    assert P.runs(np.zeros(3000, np.int64)) == [(0, 3000, 1)]
    assert P.runs(np.arange(5000) % 1700) == [(0, 5000, 1700)]
    assert P.runs(np.arange(5000)) == []


def test_query_equals_brute_force_over_whole_texts(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").toPandas()
    got = P.op12_periodic_run_detection(spark, f"{TESTDATA}/sf0.001").toPandas().set_index("doc_id")
    looped = 0
    for d in docs.itertuples():
        w = re.findall("[^\x20\x09-\x0d]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            looped += 1
        if n > 1500:
            continue
        found = sorted(brute(w), key=lambda x: (x[0], x[2]))
        row = got.loc[d.doc_id]
        assert row.n_runs == len(found)
        if found:
            start, length, q = min(found, key=lambda x: (-x[1], x[0], x[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (start, length, q, 1000 * length // q)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert looped > 5


def test_odd_rows(spark, odd_docs, no_docs):
    got = P.find(odd_docs).toPandas()
    assert len(got) == 12
    assert got["doc_id"].isna().sum() == 1
    long = got[got["doc_id"] == 5].iloc[0]
    assert [(r["start"], r["length"], r["period"]) for r in long["runs"]] == [(0, 132_000, 11)]
    assert len(long["collapsed"].split(" ")) == 11
    assert got[got["doc_id"] == 1].iloc[0]["collapsed"] == ""
    assert P.digest(P.find(P.looped(odd_docs))).count() == 12
    assert P.digest(P.find(P.looped(no_docs))).count() == 0
    named = P.find(odd_docs.selectExpr("cast(doc_id as string) as name", "text"), key="name")
    assert dict(named.dtypes)["name"] == "string"
    assert named.count() == 12


def test_texts_without_words_that_are_to_loop(spark):
    names = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    texts = ["", None, " \t\n", "one", "a b c d e f g h i j k l"]
    docs = spark.createDataFrame(list(zip(names, texts, strict=True)), "doc_id long, text string")
    got = P.digest(P.find(P.looped(docs))).toPandas().set_index("doc_id")
    assert [got.loc[i].n_words for i in names] == [0, 0, 0, 1, 12]
    empty = hashlib.sha256(b"").hexdigest()
    for i in names[:3]:
        assert (got.loc[i].n_runs, got.loc[i].runs_sha256, got.loc[i].collapsed_sha256) == (0, empty, empty)
