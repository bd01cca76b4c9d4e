import numpy as np
import pytest
from tables import TESTDATA, duck, same_rows

from driftline.plans import catalog

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same_rows(catalog.queries()[name](spark, SF).toPandas(), duck(catalog.oracle_sql()[name], SF))


def test_stage_counters(spark):
    got = {r["counter"]: r["value"] for r in catalog.queries()["stage_counters"](spark, f"{TESTDATA}/sf0.01").collect()}
    assert got.pop("num_segments") > 0
    assert got == {
        "num_messages": 9937,
        "num_discarded_filtered": 63,
        "num_initial_voyages": 390,
        "num_outlier_removal_errors": 0,
        "num_sampling_errors": 4,
        "num_voyages_after_duration_filter": 205,
        "num_messages_removed": 85,
        "num_voyages_after_outlier_removal": 205,
        "num_voyages_after_sampling": 201,
        "num_resampled_rows": 45048,
        "num_final_voyages": 203,
        "num_final_rows": 38877,
    }


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_run_that_writes_voyages_counts_its_stages(spark, sf, tmp_path):
    from driftline.operators.counters import Observed
    from driftline.sources import ais

    run = Observed(ais.from_events(spark, f"{TESTDATA}/{sf}"))
    plan = run.steps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    run.steps.write.parquet(str(tmp_path / "steps"))
    want = {r["counter"]: r["value"] for r in catalog.queries()["stage_counters"](spark, f"{TESTDATA}/{sf}").collect()}
    assert run.counters() == want
    assert spark.read.parquet(str(tmp_path / "steps")).count() == want["num_final_rows"]


def test_an_empty_run_counts_nothing(spark):
    from driftline.operators.counters import Observed
    from driftline.sources import ais

    run = Observed(ais.from_events(spark, SF).limit(0))
    run.steps.write.format("noop").mode("overwrite").save()
    assert set(run.counters().values()) == {0}


def test_final_steps_are_whole(spark):
    steps = catalog.queries()["processed_voyages"](spark, SF).toPandas()
    sizes = steps.groupby(["mmsi", "k"])["t"]
    assert sizes.count().between(48, 288).all()
    assert (steps.sort_values(["mmsi", "k", "t"]).groupby(["mmsi", "k"])["t"].diff().dropna() == 300).all()
    assert steps[["lat", "lon", "sog", "cog"]].stack().between(0, 1).all()


def test_no_vessel_is_in_two_splits(spark):
    rows = catalog.queries()["split"](spark, f"{TESTDATA}/sf0.01").toPandas()
    assert rows["mmsi"].is_unique
    assert set(rows["split"]) == {"train", "val", "test"}


def test_sequences_hold_every_report(spark):
    items = catalog.queries()["sample_items"](spark, SF).toPandas().set_index(["mmsi", "voyage"])["seqlen"]
    assert items.max() > 30
    tokens = catalog.queries()["token_seq"](spark, SF).toPandas().set_index(["mmsi", "voyage"])["n_tokens"]
    attended = catalog.queries()["pad_mask"](spark, SF).toPandas().set_index(["mmsi", "voyage"])["attention_mask"].str.count("1")
    assert (tokens == items.reindex(tokens.index) + 2).all()
    assert (attended == items.reindex(attended.index) + 2).all()


# once for the vessels' hours, of which only a few columns are read, and once for the messages; counters found apart take a pass more
@pytest.mark.parametrize(("name", "most"), [("voyages_long", 1), ("processed_voyages", 2), ("outlier_clean", 2), ("features", 2), ("stage_counters", 3), ("davies_bouldin", 2), ("resample_positions", 2)])
def test_plans_read_the_reports_seldom(spark, name, most):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= most


def test_whole_noise_grid_equals_brute_force(spark, tmp_path):
    r = np.random.RandomState(3)
    x = np.concatenate([c + r.normal(0, 0.08, (25, 3)) for c in r.normal(0, 1, (12, 3))])
    rows = [(i, [float(v) for v in p], i % 10) for i, p in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(g["n_clusters"], g["threshold"]): g["noise_pct"] for g in catalog.queries()["noise_grid_whole"](spark, str(tmp_path)).collect()}
    model = catalog._cure(spark, str(tmp_path))
    want = {}
    for k in (2, 4, 6, 8, 10, 12):
        labels, reps = model.model.labels(k), []
        for c in range(k):
            points = model.sample[labels == c]
            centre = points.mean(0)
            chosen = list(range(len(points)))
            if len(points) > 20:
                chosen = [max(range(len(points)), key=lambda i: np.linalg.norm(points[i] - centre))]
                while len(chosen) < 20:
                    chosen.append(max(range(len(points)), key=lambda i: min(np.linalg.norm(points[i] - points[j]) for j in chosen)))
            reps += [p + 0.6 * (centre - p) for p in points[chosen]]
        dist = [min(np.linalg.norm(p - q) for q in reps) for p in x]
        want |= {(k, t): pytest.approx(100 * np.mean([v > t for v in dist]), abs=1e-5) for t in (0.2, 0.22, 0.24, 0.26, 0.28, 0.3)}
    assert got == want
    assert len(set(got.values())) > 6


def test_cure_labels_equal_brute_force(spark):
    import hashlib

    rows = sorted((r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    chosen = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}:42".encode()).hexdigest(), r[0]))[:150]
    model = catalog._cure(spark, SF)
    assert (model.sample == np.array([v for _, v in chosen])).all()
    reps = model.representatives(5)
    want = {}
    for i, v in rows:
        d = [(float(np.sqrt(((v - p) ** 2).sum())), c) for c, p in reps]
        best = min(d, key=lambda x: x[0])
        want[i] = best[1] if best[0] <= 1.2 else -1
    got = {r["vec_id"]: r["label"] for r in catalog.queries()["cure_predict"](spark, SF).collect()}
    assert got == want
    assert {r["vec_id"] for r in catalog.queries()["cure_labels"](spark, SF).collect()} == set(want)
    x, labels = np.array([v for _, v in rows]), np.array([want[i] for i, _ in rows])
    centre = {c: x[labels == c].mean(0) for c in set(labels) - {-1}}
    radius = {c: np.mean([np.linalg.norm(p - centre[c]) for p in x[labels == c]]) for c in centre}
    index = np.mean([max((radius[i] + radius[j]) / np.linalg.norm(centre[i] - centre[j]) for j in centre if j != i) for i in centre])
    found = {r["n_clusters"]: r for r in catalog.queries()["cure_evaluate"](spark, SF).collect()}
    assert sorted(found) == [2, 5, 10, 20]
    assert found[5]["davies_bouldin"] == pytest.approx(index, abs=1e-5)
    assert found[5]["noise_pct"] == pytest.approx(100 * (labels == -1).mean(), abs=1e-5)


def test_principal_components_equal_numpy(spark):
    rows = sorted((r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    x = np.array([v for _, v in rows])
    x -= x.mean(0)
    loadings = np.linalg.svd(x, full_matrices=False)[2][:2].T
    loadings *= np.sign(loadings[abs(loadings).argmax(0), [0, 1]])
    got = {r["vec_id"]: (r["x"], r["y"]) for r in catalog.queries()["scatter_frame"](spark, SF).collect()}
    assert all(got[i] == pytest.approx(p, abs=1e-5) for (i, _), p in zip(rows, x @ loadings, strict=True))


def test_dendrogram_has_the_last_merges(spark):
    rows = catalog.queries()["dendrogram"](spark, SF).collect()
    model = catalog._cure(spark, SF).model
    live = [m for m in model.merges]
    assert len(rows) == min(30, len(live))
    assert [r["dist"] for r in rows] == pytest.approx([m[2] for m in live][-len(rows) :])
    assert rows[-1]["size"] == model.n - len(model.noise)
