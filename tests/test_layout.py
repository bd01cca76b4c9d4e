"""The graph of neighbours and the layout, against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import layout, neighbours
from driftline.operators.frames import reduced


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "vec_id long, embedding array<double>")


def distances(x):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return d


def trustworthiness(x, p, k):
    """1 less the ranks by which the plane's neighbours are too far in space."""
    n, rank = len(x), distances(x).argsort(1).argsort(1)
    near = distances(p).argsort(1)[:, :k]
    return 1 - 2 * np.maximum(np.take_along_axis(rank, near, 1) + 1 - k, 0).sum() / (n * k * (2 * n - 3 * k - 1))


def test_graph_and_exact_search_against_all_distances(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP", 8)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "EXACT_BLOCK", 70)
    x = np.random.RandomState(3).normal(size=(400, 8))
    x[:60] = x[0]  # one place holds many
    rows = table(spark, x)
    d = distances(x)
    exact = neighbours.exact(rows.filter("vec_id % 20 = 0"), rows, 5)
    for r in exact.groupBy("id").agg(F.sort_array(F.collect_list("dist")).alias("d")).collect():
        assert r["d"] == pytest.approx(np.sort(d[r["id"]])[:5].tolist())
    found = neighbours.graph(rows, 5).toPandas()
    assert len(found) == 400 * 5
    assert not found.duplicated(["id", "to"]).any()
    assert (found["id"] != found["to"]).all()
    # every distance is the pair's own
    assert found["dist"].to_numpy() == pytest.approx(d[found["id"], found["to"]])
    assert all(sorted(p) == [1, 2, 3, 4, 5] for _, p in found.groupby("id")["place"])
    share = neighbours.recall(spark.createDataFrame(found), exact).agg(F.sum("n_found") / F.sum("n_exact")).first()[0]
    assert share >= 0.9


def test_few_rows_and_null_ones(spark):
    rows = table(spark, np.eye(3))
    mixed = rows.unionByName(spark.createDataFrame([(None, [1.0, 2.0, 3.0]), (9, None)], rows.schema)).withColumn("to", F.lit("x")).withColumn("id", F.lit(1))
    assert {(r["id"], r["to"]) for r in neighbours.graph(mixed, 5).collect()} == {(i, j) for i in range(3) for j in range(3) if i != j}
    assert neighbours.graph(rows.limit(1)).count() == neighbours.graph(rows.limit(0)).count() == 0
    assert layout.layout(rows.limit(0)).count() == 0
    assert sorted(r["vec_id"] for r in layout.layout(mixed, rounds=1, steps=2).collect()) == [0, 1, 2]


def test_weights(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 1, 1.0), (3, 1, 2.0), (3, 4, 2.5)], "id long, to long, dist double")
    got = {(r["id"], r["to"]): r["w"] for r in layout.weights(edges).collect()}

    def own(ds):
        near, sigma = layout.scale(np.array(ds))
        return np.exp(-(np.array(ds) - near) / sigma)

    one, three = own([1.0, 2.0]), own([2.0, 2.5])
    assert got[1, 2] == got[2, 1] == pytest.approx(1.0)
    assert got[1, 3] == got[3, 1] == pytest.approx(one[1] + three[0] - one[1] * three[0])
    assert got[3, 4] == pytest.approx(three[1])
    near, sigma = layout.scale(np.array([0.5, 0.7, 0.8, 1.0, 1.4, 2.0]))
    assert np.exp(-(np.array([0.5, 0.7, 0.8, 1.0, 1.4, 2.0]) - near) / sigma).sum() == pytest.approx(np.log2(6))


def test_a_step_draws_ends_together_and_pushes_others_away():
    at = np.array([[0.0, 0.0], [4.0, 0.0], [9.0, 0.0]])
    head, tail, w = np.array([0, 2]), np.array([1, -1]), np.ones(2)
    out = layout.moved(at, head, tail, w, np.array([[0.0, 0.0], [9.0, 3.0]]), np.zeros((0, 2)), np.array([0.5]), 1)
    assert out[1, 0] - out[0, 0] < 4
    # the end in another block stands still, its point comes nearer
    assert out[2, 1] > 0
    pushed = layout.moved(at[:1] + 0.5, np.array([0]), np.array([-1]), w[:1], np.array([[0.5, 0.5]]), np.array([[0.0, 0.0]]), np.array([0.5]), 1)
    assert (pushed > 0.5).all()


def test_layout_keeps_neighbours_better_than_components(spark, monkeypatch):
    monkeypatch.setattr(layout, "BLOCK", 150)
    # a curl through eight dimensions, which no plane unrolls
    r = np.random.RandomState(1)
    t = r.rand(500) * 12
    x = np.stack([f(t * s) for s in (0.5, 1.0, 1.7, 2.3) for f in (np.sin, np.cos)], 1) + r.normal(0, 0.02, (500, 8))
    rows = table(spark, x)
    plane = layout.layout(rows, k=10).toPandas().sort_values("vec_id")[["x", "y"]].to_numpy()
    flat = np.stack(reduced(rows).toPandas().sort_values("vec_id")["point"])
    assert np.isfinite(plane).all()
    assert trustworthiness(x, plane, 10) > max(0.95, trustworthiness(x, flat, 10))


@pytest.mark.parametrize("k", [3, 5])
def test_the_nearest_in_a_block_are_the_first_by_distance_and_id(monkeypatch, k):
    for name, value in (("ROWS", 16), ("COLUMNS", 13)):
        monkeypatch.setattr(neighbours.blocks, name, value)
    r = np.random.RandomState(6)
    x = np.round(r.normal(size=(90, 3)) * 2) / 2 + 100  # many ties, far from the origin
    ids = r.permutation(90)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    got = [t for part in neighbours._closest(ids, ids, x, x, k) for t in zip(*(c.tolist() for c in part), strict=True)]
    want = [(i, j, d[i, j]) for i in range(90) for j in sorted((j for j in range(90) if j != i), key=lambda j: (d[i, j], ids[j]))[:k]]
    assert got == want


def test_a_graph_of_no_very_many_vectors_is_exact_and_a_larger_one_is_descended(spark):
    x = np.random.RandomState(3).normal(size=(300, 24))  # no structure: a descent misses some
    rows, d = table(spark, x), distances(x)
    found = neighbours.graph(rows, 5, wider=1).toPandas().sort_values(["id", "place"])
    assert found["dist"].to_numpy() == pytest.approx(np.sort(d)[:, :5].ravel())
    near = neighbours.graph(rows, 5, wider=1, most=0).toPandas()
    assert not near.duplicated(["id", "to"]).any()
    assert near["dist"].to_numpy() == pytest.approx(d[near["id"], near["to"]])


def test_layout_needs_no_descent_for_no_very_many_vectors(spark, monkeypatch):
    def never(*_):
        raise AssertionError("vectors were sent to all that they may meet")

    monkeypatch.setattr(neighbours, "_met", never)
    rows = table(spark, np.random.RandomState(3).normal(size=(60, 4)))
    assert layout.layout(rows, k=5, rounds=1, steps=2).count() == 60


@pytest.mark.parametrize("kind", ["plain", "far", "tiny", "outlier"])
def test_single_precision_leaves_no_neighbour_out(monkeypatch, kind):
    for name, value in (("ROWS", 16), ("COLUMNS", 33)):
        monkeypatch.setattr(neighbours.blocks, name, value)
    r = np.random.RandomState(6)
    x = r.normal(size=(120, 5))
    if kind == "far":  # neighbours are nearer than single precision tells apart
        x = 1e-5 * x + 1e3 * (np.arange(120) % 3)[:, None]
    elif kind == "tiny":
        x *= 1e-30
    elif kind == "outlier":
        x[40] += 1e7
    ids, kinds, quick = r.permutation(120), [], neighbours.blocks.tiles

    def noted(*a, **named):
        for tile in quick(*a, **named):
            kinds.append(tile[2].dtype)
            yield tile

    monkeypatch.setattr(neighbours.blocks, "tiles", noted)
    got = [t for part in neighbours._closest(ids, ids, x, x, 4) for t in zip(*(c.tolist() for c in part), strict=True)]
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    assert got == [(i, j, d[i, j]) for i in range(120) for j in sorted((j for j in range(120) if j != i), key=lambda j: (d[i, j], ids[j]))[:4]]
    # single precision does the work, and double only what that leaves open
    assert kinds.count(np.dtype(np.float32)) == 8 * 4
    assert (np.dtype(np.float64) in kinds) == (kind in ("far", "outlier"))
