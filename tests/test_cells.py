"""Searches by cells against all distances."""

import numpy as np
import pytest

from driftline.operators import cells, clustering, spanning


def blobs(n, groups, dims=4, seed=1, spread=0.05):
    r = np.random.RandomState(seed)
    centres = r.normal(0, 1, (groups, dims))
    label = r.randint(0, groups, n)
    return centres[label] + r.normal(0, spread, (n, dims)), label


def table(spark, x, label, key="vec_id"):
    return spark.createDataFrame([(i, [float(v) for v in p], int(g)) for i, (p, g) in enumerate(zip(x, label, strict=True))], f"{key} long, embedding array<double>, label int")


@pytest.mark.parametrize(("n_pivots", "block"), [(1, 50), (40, 30), (200, 4096)])
def test_nearest_of_many_equals_dense(spark, monkeypatch, n_pivots, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    x, _ = blobs(300, 7)
    y, _ = blobs(500, 7)
    y[100] = y[7]
    labels = np.arange(500) * 37 % 91
    got = {r["vec_id"]: (r["label"], r["dist"]) for r in cells.nearest(table(spark, x, np.zeros(300)), table(spark, y, labels, "rep_id"), 0.08, n_pivots=n_pivots).collect()}
    d = np.sqrt(((x[:, None] - y) ** 2).sum(-1))
    for i in range(300):
        best = d[i].min()
        want = -1 if best > 0.08 else min(labels[d[i] == best])
        assert got[i] == (want, pytest.approx(best))
    assert -1 in {v[0] for v in got.values()}


def test_most_distances_are_skipped_on_clustered_data(spark):
    x, _ = blobs(1500, 60, 3, spread=0.02)
    y, labels = blobs(4000, 60, 3, spread=0.02)
    got = cells.nearest(table(spark, x, np.zeros(1500)), table(spark, y, labels, "rep_id"), n_pivots=128)
    assert got.agg({"measured": "sum"}).first()[0] < 0.1 * 1500 * 4000


def test_no_members(spark):
    x, g = blobs(5, 2)
    rows = table(spark, x, g)
    got = cells.nearest(rows, table(spark, x, g, "rep_id").limit(0)).collect()
    assert {r["label"] for r in got} == {-1}
    assert cells.nearest(rows.limit(0), table(spark, x, g, "rep_id")).count() == 0


def test_worst_ratios_equal_all_pairs(spark):
    x, _ = blobs(400, 9, seed=5)
    x[3] = x[2]
    r = np.random.RandomState(2).rand(400) * 0.1
    r[:20] = 0
    rows = spark.createDataFrame([(i, [float(v) for v in p], float(w)) for i, (p, w) in enumerate(zip(x, r, strict=True))], "label long, centroid array<double>, radius double")
    got = {q["label"]: q["ratio"] for q in cells.worst_ratios(rows, 50).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    with np.errstate(divide="ignore"):
        ratio = np.where(d > 0, (r[:, None] + r) / d, 0)
    assert [got[i] for i in range(400)] == pytest.approx(ratio.max(1).tolist())


def prim(x):
    """The minimum spanning tree's edges, ordered by length and ends, one vertex at a time."""
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    inside, out = {0}, set()
    while len(inside) < len(x):
        rest = [j for j in range(len(x)) if j not in inside]
        best = min((d[i, j], min(i, j), max(i, j), j) for i in inside for j in rest)
        out.add(best[:3])
        inside.add(best[3])
    return out


def test_spanning_tree_equals_brute_force(spark):
    x, g = blobs(90, 5, 2, seed=3)
    x[:40] = np.round(x[:40] * 4) / 4  # many ties
    tree = spanning.spanning_tree(table(spark, x, g), n_pivots=12)
    got = {(r["dist"], r["a"], r["b"]) for r in tree.edges.collect()}
    assert got == prim(x)
    merged = spanning.merges(tree).orderBy("rank").collect()
    assert [r["rank"] for r in merged] == list(range(89))
    assert [(r["dist"], r["a"], r["b"]) for r in merged] == sorted(got)


def test_single_linkage_measures_few_distances_on_clustered_data(spark):
    x, g = blobs(1200, 40, 3, seed=8, spread=0.01)
    rows = table(spark, x, g)
    tree = spanning.spanning_tree(rows)
    assert tree.edges.count() == 1199
    assert tree.measured < 0.2 * 1200 * 1199 / 2
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    label = np.arange(1200)
    for i in range(1200):
        near = np.flatnonzero(d[i] <= 0.03)
        low = label[near].min()
        for old in set(label[near]) - {low}:
            label[label == old] = low
    got = {r["vec_id"]: r["label"] for r in spanning.cut_at(tree, rows, 0.03).collect()}
    assert [got[i] for i in range(1200)] == label.tolist()
    assert 1 < len(set(label)) < 1200


def test_many_clusters_have_the_index_that_few_have(spark):
    x, _ = blobs(600, 9, seed=5)
    rows = table(spark, x, np.arange(600) // 3)
    few, many = (clustering.davies_bouldin(rows, most=m).first()[0] for m in (1000, 100))
    assert many == pytest.approx(few)


@pytest.mark.parametrize("held", [16, 1 << 20])
def test_the_tree_up_to_a_length_is_the_tree_without_longer_edges(spark, monkeypatch, held):
    monkeypatch.setattr(spanning, "HELD", held)
    for name, value in (("FEW", 20), ("ROWS", 7), ("COLUMNS", 11)):
        monkeypatch.setattr(spanning.blocks, name, value)
    x, g = blobs(90, 5, 2, seed=3)
    x[:40] = np.round(x[:40] * 4) / 4  # many ties and copies
    rows = table(spark, x, g)
    whole = prim(x)
    for up_to in (0.0, 0.08, 0.5, 100.0):
        tree = spanning.spanning_tree(rows, up_to=up_to)
        assert {(r["dist"], r["a"], r["b"]) for r in tree.edges.collect()} == {e for e in whole if e[0] <= up_to}
        # all pairs are measured once, not once in each round
        assert tree.measured <= 90 * 89 / 2
    assert spanning.spanning_tree(rows.limit(0), up_to=1.0).edges.count() == 0


@pytest.mark.parametrize("copied", [False, True])
def test_linkages_of_clusters_equal_all_pairs(spark, monkeypatch, copied):
    from driftline.operators import blocks

    for name, value in (("FEW", 40), ("ROWS", 16), ("COLUMNS", 33)):
        monkeypatch.setattr(blocks, name, value)
    x, g = blobs(300, 5, 6, seed=4)
    x = x + 1000  # far from the origin, products lose digits
    if copied:
        x[:150] = x[150:]
    got = {(r["i"], r["j"]): (r["single"], r["average"]) for r in clustering.pair_linkages(table(spark, x, g + 3)).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    assert set(got) == {(i + 3, j + 3) for i in range(5) for j in range(5) if i < j}
    for (i, j), (least, mean) in got.items():
        part = d[np.ix_(g == i - 3, g == j - 3)]
        assert least == part.min()
        assert mean == pytest.approx(part.mean(), rel=1e-9)


def test_a_search_keeps_each_step_in_python_apart(spark, monkeypatch):
    plans, keep = [], cells.kept

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df)

    monkeypatch.setattr(cells, "kept", noted)
    x, g = blobs(60, 5)
    rows = table(spark, x, g)
    found = cells.nearest(rows, table(spark, x, g, "rep_id"), n_pivots=8)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert found.count() == 60
    steps = [sum(p.count(name) for name in ("MapInArrow", "FlatMapCoGroupsInArrow")) for p in plans]
    assert max(steps) == 1 and sum(steps) >= 5



def test_a_vector_is_sent_as_often_in_a_large_table_as_in_a_small_one():
    from driftline.operators import blocks

    assert blocks.how_many(0, 64) == blocks.how_many(400, 64) == 1
    assert {blocks.how_many(n, 64) for n in (12_288, 102_560, 615_360, 1_500_000)} == {blocks.SPREAD}
    # a block's numbers are bounded all the same
    assert blocks.how_many(100_000_000, 64) * blocks.NUMBERS >= 100_000_000 * 64


@pytest.mark.parametrize("copied", [False, True])
def test_the_least_distances_of_clusters_are_those_of_all_pairs(spark, monkeypatch, copied):
    from driftline.operators import blocks

    for name, value in (("FEW", 40), ("ROWS", 16), ("COLUMNS", 33)):
        monkeypatch.setattr(blocks, name, value)
    x, g = blobs(300, 5, 6, seed=4)
    x = x + 1000
    if copied:
        x[:150] = x[150:]
        g[200:] = g[:100]
    got = {(r["i"], r["j"]): r["single"] for r in clustering.pair_singles(table(spark, x, g + 3)).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    assert got == {(i + 3, j + 3): d[np.ix_(g == i, g == j)].min() for i in range(5) for j in range(5) if i < j}


def test_single_linkage_sends_and_measures_copies_once(spark, monkeypatch):
    from driftline.operators import blocks

    sizes = []
    monkeypatch.setattr(blocks, "how_many", lambda n, dims, *_: sizes.append(n) or 2)
    x, g = blobs(50, 4, 3)
    few = {tuple(r) for r in clustering.pair_singles(table(spark, x, g)).collect()}
    many = {tuple(r) for r in clustering.pair_singles(table(spark, np.tile(x, (6, 1)), np.tile(g, 6))).collect()}
    assert few == many and sizes == [50, 50]


@pytest.mark.parametrize("kind", ["plain", "far", "tiny", "outlier", "huge", "equal"])
def test_single_precision_leaves_no_least_pair_out(monkeypatch, kind):
    from driftline.operators import blocks

    for name, value in (("ROWS", 16), ("COLUMNS", 33)):
        monkeypatch.setattr(blocks, name, value)
    r = np.random.RandomState(2)
    x, y = r.normal(size=(90, 7)), r.normal(size=(150, 7))
    if kind == "far":  # near pairs differ by less than single precision tells apart
        x, y = 1e-5 * x + 1e3 * (np.arange(90) % 3)[:, None], 1e-5 * y + 1e3 * (np.arange(150) % 3)[:, None]
    elif kind == "tiny":
        x, y = x * 1e-30, y * 1e-30
    elif kind == "outlier":
        y[40] += 1e7
    elif kind == "huge":
        x, y = x * 1e25, y * 1e25
    elif kind == "equal":
        x[:], y[:] = 0.3, 0.3
    of_x, of_y = np.sort(r.randint(0, 6, 90)), np.sort(r.randint(0, 9, 150))
    asked = r.rand(6, 9) < 0.7
    made = []
    quick = blocks.tiles
    monkeypatch.setattr(blocks, "tiles", lambda *a: made.append(a[3] if len(a) > 3 else 0) or quick(*a))
    i, j, least = clustering._leasts(x, y, of_x, of_y, asked)
    d = np.sqrt(((x[:, None] - y) ** 2).sum(-1))
    assert {(p, q): v for p, q, v in zip(i.tolist(), j.tolist(), least.tolist(), strict=True)} == {(p, q): d[np.ix_(of_x == p, of_y == q)].min() for p in range(6) for q in range(9) if asked[p, q]}
    # single precision comes first, whatever the scale
    assert made[0] > 0
