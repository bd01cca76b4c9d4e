"""The join against brute force over all pairs, with blocks small enough that groups span many."""

import random
import re

import numpy as np

from driftline.llm import ngram_join as J


def brute(texts):
    """{key: (n, component, links)} of texts by key."""
    sets = {}
    for k, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    keys = sorted(sets)
    near = {k: [o for o in keys if o != k and sets[k] and sets[o] and 100 * len(sets[k] & sets[o]) >= 85 * len(sets[k] | sets[o])] for k in keys}
    out = {}
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            for o in near[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        out[k] = (len(sets[k]), min(seen), len(near[k]))
    return out


def corpus(seed):
    """Groups of edited copies from two to eighty, chains, exact copies, a passage that most share, and texts of their own."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 4000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for size in (2, 3, 2, 5, 80, 9, 2, 14):
        base = [word() for _ in range(r.randint(25, 160))]
        base = passage + base if r.random() < 0.6 else base
        for i in range(size):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 50))):
                copy[r.randrange(len(copy))] = word()
            texts.append(copy)
    chain = [word() for _ in range(100)]
    for i in range(12):
        texts.append(chain[3 * i :] + [f"c{j}" for j in range(3 * i)])
    texts += [["one"], ["one"], ["one", "two"], ["One", "two"], [], ["a", "b", "c", "d"], ["a", "b", "c", "d"]]
    texts += [[word() for _ in range(r.randint(4, 60))] for _ in range(60)] + [texts[0]] * 30
    texts += [passage + [word() for _ in range(4)] for _ in range(40)]
    r.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_links_and_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS", 7)
    monkeypatch.setattr(J, "GRAMS", 600)
    texts = corpus(1)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in J.similar(docs).collect()}
    assert got == brute(texts)


def test_products_equal_intersections(monkeypatch):
    monkeypatch.setattr(J, "DENSE", 5)
    monkeypatch.setattr(J, "SPARSE", 50)
    r = np.random.RandomState(3)
    for share in (1 / 256, 0.2, 0, 2):
        monkeypatch.setattr(J, "DENSE_SHARE", share)
        for m, n in ((9, 14), (1, 30), (40, 3)):
            left, right = ([np.unique(r.choice(np.array([r.randint(0, 20), r.randint(0, 400)]), r.randint(0, 60)) + r.randint(0, 90, 1)).astype(np.uint64) for _ in range(k)] for k in (m, n))
            left[0] = right[0] = np.arange(100, dtype=np.uint64)
            assert (J.product(left, right) == [[len(np.intersect1d(a, b)) for b in right] for a in left]).all()


def test_a_column_block_hears_of_merged_rows_once():
    sets = [np.arange(0, 50, dtype=np.uint64) * np.uint64(7919), np.arange(0, 40, dtype=np.uint64) * np.uint64(7919)]
    dealt = list(J._deal(sets, np.array([11, 22]), 4))
    assert dealt[0][0] == -1
    assert np.frombuffer(dealt[0][3], "<u4").tolist() == [40, 40]
    assert sum(len(g) // 4 for _, g, _, _ in dealt[1:]) == 50
    again = list(J._deal([sets[0]], np.array([33]), 4))
    shared = {}
    for b in range(4):
        here = [x for x in (*dealt, *again) if x[0] == b]
        for own, n in zip(*J._met(*([x[i] for x in here] for i in (1, 2, 3))), strict=True):
            shared[int(own)] = shared.get(int(own), 0) + int(n)
    assert shared == {11: 10, 33: 50}


def test_odd_rows(spark, odd_docs, no_docs):
    got = J.similar(odd_docs).toPandas()
    assert len(got) == 12
    assert got[got["doc_id"] == 6][["component_id", "n_links"]].values.tolist() == [[6, 2]]
    assert got[got["doc_id"] == 7][["component_id", "n_links"]].values.tolist() == [[6, 2]] * 2
    assert got[got["doc_id"].isin([1, 2, 3])]["n_shingles"].tolist() == [0, 0, 0]
    assert got[got["doc_id"].isna()]["component_id"].isna().tolist() == [True]
    assert J.similar(no_docs).count() == 0
    named = J.similar(odd_docs.selectExpr("concat('k', doc_id) as name", "text"), key="name").toPandas()
    assert set(named[named["n_links"] > 0]["component_id"]) == {"k6"}
