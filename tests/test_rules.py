import math
import random

import numpy as np
import pytest

from driftline.functions.geodesic import with_direct, with_inverse
from driftline.operators import clustering, features, ingest, outliers, voyages
from driftline.sources import ais

COLUMNS = "mmsi long, ts_s long, seq long, lat double, lon double, sog double, cog double, heading double, rot double, nav_status int"


def track(spark, times, mmsi=1, sog=10.0):
    speeds = sog if isinstance(sog, list) else [sog] * len(times)
    return spark.createDataFrame([(mmsi, t, i, 55.0, 10.0, s, 90.0, None, 0.0, 0) for i, (t, s) in enumerate(zip(times, speeds, strict=True))], COLUMNS)


def test_a_gap_of_two_hours_stays_and_one_second_more_splits(spark):
    got = voyages.split(track(spark, [0, 7200, 14401])).orderBy("ts_s").collect()
    assert [r["voyage"] for r in got] == [0, 0, 1]


@pytest.mark.parametrize(("n", "last", "kept"), [(20, 14400, 1), (19, 14400, 0), (20, 14399, 0)])
def test_short_voyages_go(spark, n, last, kept):
    times = [*range(0, 700 * (n - 1), 700)][: n - 1] + [last]
    assert voyages.long_stats(voyages.split(track(spark, sorted(times)))).count() == kept
    assert (voyages.long_voyages(voyages.split(track(spark, sorted(times)))).count() > 0) == bool(kept)


def test_range_bounds_are_inclusive_and_nulls_go(spark):
    rows = [(54.0, 5.0, 30.0, 360.0), (59.0, 17.0, 0.0, 0.0), (53.9, 5.0, 1.0, 1.0), (55.0, 17.1, 1.0, 1.0), (55.0, 10.0, 30.1, 1.0), (55.0, 10.0, None, 1.0), (55.0, 10.0, float("nan"), 1.0), (None, 10.0, 1.0, 1.0)]
    assert ingest.in_range(spark.createDataFrame(rows, "lat double, lon double, sog double, cog double")).count() == 2


def test_ticks_of_tied_messages_and_the_end(spark):
    got = voyages.ticks(voyages.split(track(spark, [0, 600, 600, 900]))).orderBy("t").collect()
    assert [(r["t"], r["seq"]) for r in got] == [(0, 0), (300, 0), (600, 2)]


@pytest.mark.parametrize(("n", "kept"), [(47, 0), (48, 1), (289, 1)])
def test_chunk_lengths(spark, n, kept):
    rows = voyages.linear(voyages.ticks(voyages.split(track(spark, list(range(0, 300 * n + 1, 300))))))
    assert rows.count() == n
    assert voyages.chunk_stats(voyages.chunks(rows)).count() == kept


def test_a_share_of_four_fifths_slow_stays(spark):
    speeds = ([1.0] * 4 + [10.0]) * 20
    rows = voyages.split(track(spark, list(range(0, 300 * 100, 300)), sog=speeds)).withColumnRenamed("ts_s", "t").withColumn("tick", voyages.F.col("seq"))
    got = voyages.chunk_stats(voyages.chunks(rows)).collect()
    assert [round(r["slow_share"], 9) for r in got] == [0.8]
    assert voyages.final_steps(rows).count() == 100


def test_a_bracket_over_two_hours_loses_the_voyage(spark):
    rows = voyages.split(track(spark, [0, 7200])).unionByName(voyages.split(track(spark, [0, 10], mmsi=2)))
    assert voyages.sampled(rows).count() == 4
    wide = track(spark, [0, 7201]).withColumn("voyage", voyages.F.lit(0))
    assert voyages.sampled(wide).count() == 0


def test_published_geodesic(spark):
    rows = spark.createDataFrame([(-37.951033417, 144.424867889, -37.652821139, 143.926495528), (10.0, 10.0, 10.0, 10.0), (0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    got = [r["m"] for r in with_inverse(rows, "a", "b", "c", "d", "m").collect()]
    assert got == pytest.approx([54972.271, 0.0, 111319.4908], abs=1e-3)
    there = with_direct(with_inverse(rows, "a", "b", "c", "d", "m", "az"), "a", "b", "az", "m", "e", "f").collect()
    assert [(r["e"], r["f"]) for r in there] == [pytest.approx((r["c"], r["d"]), abs=1e-9) for r in there]


def test_greedy_removal_takes_the_first_of_the_most_tied():
    assert outliers.greedy([]) == []
    assert outliers.greedy([(0, 1)]) == [0]
    assert outliers.greedy([(0, 1), (1, 2), (1, 3)]) == [1]
    r = random.Random(3)
    for _ in range(200):
        edges = sorted({(a, a + r.randint(1, 4)) for a in r.choices(range(12), k=8)})
        left, want = set(edges), []
        while left:
            counts = {n: sum(n in e for e in left) for n in {n for e in left for n in e}}
            worst = min(counts, key=lambda n: (-counts[n], n))
            want.append(worst)
            left = {e for e in left if worst not in e}
        assert outliers.greedy(edges) == want


def brute_merges(x, linkage):
    groups, names, out = [[i] for i in range(len(x))], list(range(len(x))), []
    while len(groups) > 1:
        d = {(i, j): clustering.cluster_distance(x[groups[i]], x[groups[j]], linkage) for i in range(len(groups)) for j in range(i + 1, len(groups))}
        i, j = min(d, key=d.get)
        out.append((names[i], names[j], d[i, j]))
        both, name = groups[i] + groups[j], len(x) + len(out) - 1
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [both]
        names = [g for k, g in enumerate(names) if k not in (i, j)] + [name]
    return out


@pytest.mark.parametrize("linkage", clustering.LINKAGES)
def test_merging_equals_brute_force(linkage):
    x = np.random.RandomState(1).rand(18, 3)
    got = clustering.Agglomeration(linkage).fit(x)
    want = brute_merges(x, linkage)
    assert [m[:2] for m in got.merges] == [m[:2] for m in want]
    assert [m[2] for m in got.merges] == pytest.approx([m[2] for m in want])
    for k in (1, 2, 5, 18):
        assert len(set(got.labels(k))) == k


def test_pruned_points_are_noise_and_labels_stay_whole():
    x = np.concatenate([np.random.RandomState(2).rand(20, 2), [[50.0, 50.0]]])
    got = clustering.Agglomeration("average", pruning_fraction=0.3, pruning_min_size=1).fit(x)
    assert 20 in got.noise
    labels = got.labels(2)
    assert labels[20] == -1
    assert set(labels) - {-1} == {0, 1}
    assert clustering.Agglomeration("average", 1.0, 5).fit(x).merges == []
    with pytest.raises(ValueError, match="linkage"):
        clustering.Agglomeration("other").fit(x)


def test_model_survives_saving(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(np.random.RandomState(4).rand(60, 4))], "vec_id long, embedding array<double>")
    model = clustering.Cure(sample_size=30, linkage="ward", threshold=0.4).fit(rows)
    model.save(spark, str(tmp_path / "cure"))
    again = clustering.Cure.load(spark, str(tmp_path / "cure"))
    assert sorted(model.predict(rows, 3).collect()) == sorted(again.predict(rows, 3).collect())
    with pytest.raises(RuntimeError):
        clustering.Cure().representatives(2)


def test_coincident_centroids_and_a_single_cluster(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert clustering.davies_bouldin(one).first()[0] == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert clustering.davies_bouldin(two).first()[0] == 0


def test_lookup_raises_for_nothing(spark):
    items = spark.createDataFrame([(1, 5)], "mmsi int, time_start int")
    assert features.sample_lookup(items, 1, 5).count() == 1
    with pytest.raises(KeyError):
        features.sample_lookup(items, 1, 6)


def test_csv_rows_and_quarantine(spark, tmp_path):
    (tmp_path / "aisdk-2024-01-05.csv").write_text(
        "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,Navigational status,ROT,SOG,COG,Heading,Ship type\n"
        "05/01/2024 00:00:10,Class A,219000001,55.5,10.5,Moored,,5.0,90.0,91,Cargo\n"
        "not a time,Class A,219000001,55.5,10.5,Odd,,5.0,90.0,,Nothing\n"
    )
    rows = ais.coded(ais.read_csv(spark, str(tmp_path)))
    got = rows.orderBy("seq").collect()
    assert [(r["mmsi"], r["ts_s"], r["nav_status"], r["vessel_type"], r["heading"], str(r["file_date"])) for r in got] == [(219000001, 1704412810, 5, 70, 91, "2024-01-05"), (219000001, None, 15, 0, None, "2024-01-05")]
    assert ais.quarantine(rows).count() == 1
    assert ingest.in_range(rows, own_day=True).count() == 1


def test_sequences_are_cut_only_where_they_are_longer_than_the_room(spark):
    steps = [[float(i)] * 4 for i in range(10)]
    items = spark.createDataFrame([(1, 0, steps)], "mmsi int, voyage long, features array<array<float>>")
    cut, whole = (features.token_sequences(items, n).first()["tokens"] for n in (8, 12))
    assert cut == [[-1.0] * 4, *steps[:6], [-2.0] * 4]
    assert whole == [[-1.0] * 4, *steps, [-2.0] * 4]


def test_marks_equal_the_edges_and_the_greedy_choice(spark):
    from driftline.functions.geodesic import inverse

    r = random.Random(12)
    rows = []
    for mmsi in range(6):
        t, lat = 0, 55.0
        for i in range(r.choice([1, 3, 40, 700])):
            t += r.choice([1, 2, 10, 60])
            lat += 0.0005
            jump = r.choice([0.0] * 8 + [0.02, 0.3]) if mmsi != 5 else 0.5 * (i % 2)
            rows.append((mmsi, t, i, lat + jump, 10.0, 1.0, 1.0, None, 0.0, 0))
    voyage = spark.createDataFrame(rows, COLUMNS).withColumn("voyage", voyages.F.lit(0).cast("long"))
    edges = {}
    for mmsi in range(6):
        own = [x for x in rows if x[0] == mmsi]
        for a in range(len(own)):
            for b in range(a + 1, min(a + 5, len(own))):
                dt = own[b][1] - own[a][1]
                d = float(inverse(*(np.array([x]) for x in (own[a][3], own[a][4], own[b][3], own[b][4])))[0])
                if dt > 2 and d / dt > 30 * 0.514444:
                    edges.setdefault(mmsi, []).append((a, b))
    assert {m: sorted((e["a"], e["b"]) for e in voyages.speed_edges(voyage).filter(f"mmsi = {m}").collect()) for m in edges} == edges
    want = {(m, i) for m, e in edges.items() for i in outliers.greedy(e)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(x["mmsi"], x["idx"]) for x in outliers.flagged(voyage).collect()}
        kept = outliers.clean(voyage).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    single = sum(len([x for x in rows if x[0] == m]) == 1 for m in range(6))
    assert kept == len(rows) - len(want) - single


def test_the_speed_limit_and_the_choice_can_be_changed(spark):
    # 7 knots, but the third message is 2 km off, too far from the two before (43 and 79 knots) and the one after (65, then 29); the fifth reports 25 knots
    rows = [(1, 60 * i, i, 55.0 + 0.002 * i + (0.02 if i == 2 else 0), 10.0, 25.0 if i == 4 else 9.0, 1.0, None, 0.0, 0) for i in range(8)]
    voyage = spark.createDataFrame(rows, COLUMNS).withColumn("voyage", voyages.F.lit(0).cast("long"))
    seqs = lambda d: sorted(r["seq"] for r in d.collect())
    assert seqs(outliers.clean(voyage)) == [0, 1, 3, 4, 5, 6, 7]
    assert seqs(outliers.clean(voyage, speed_max=20.0)) == [0, 1, 3, 5, 6, 7]
    assert seqs(outliers.clean(voyage, speed_max=200.0)) == list(range(8))
    assert seqs(outliers.clean(voyage, choose=lambda edges: sorted({n for e in edges for n in e}))) == [4, 5, 6, 7]


def test_a_sample_is_the_same_at_any_size_and_partitioning(spark):
    import hashlib

    frame = spark.range(20_000).selectExpr("id as vec_id", "array(cast(id as double), 1d) as embedding")
    want = sorted(range(20_000), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())[:1000]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for parts in (1, 16, 61):
            got = clustering.Cure().sampled(frame.repartition(parts)).collect()
            assert [r["vec_id"] for r in sorted(got, key=lambda r: r["nth"])] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert clustering.Cure(sample_size=50).sampled(frame.limit(20)).count() == 20
    assert clustering.Cure().sampled(frame.limit(0)).count() == 0


def test_places_and_splits_of_many_vessels(spark):
    frame = spark.range(30_000).selectExpr("id % 7000 + 219000000 as mmsi", "cast(id / 7000 as int) as k")
    got = features.sample_index(frame).collect()
    names = sorted(f"{i % 7000 + 219000000}_{i // 7000}_processed.pkl" for i in range(30_000))
    assert {r["file_name"]: r["sample_idx"] for r in got} == {n: i for i, n in enumerate(names)}
    sizes = {r["split"]: r["n"] for r in features.split_vessels(frame).groupBy("split").agg(voyages.F.sum("n").alias("n")).collect()}
    assert sum(sizes.values()) == 30_000
    assert all(abs(sizes[s] - 3000) < 10 for s in ("val", "test"))


def test_archives_and_their_problems(spark, tmp_path):
    import datetime
    import zipfile

    from driftline.sources import landing

    text = "# Timestamp,MMSI,Latitude,Longitude,Navigational status,ROT,SOG,COG,Heading,Ship type,More\n05/01/2024 00:00:10,219000001,55.5,10.5,Moored,,5.0,90.0,91,Cargo,x\n05/01/2024 00:00:20,219000001,55.6,10.5,Moored,odd,5.0,90.0,91,Cargo,\n"
    for day, members in ((5, {"a.csv": text}), (6, {"a.csv": text, "b.csv": text}), (8, {"a.csv": ""})):
        with zipfile.ZipFile(tmp_path / f"aisdk-2024-01-{day:02}.zip", "w") as z:
            for n, t in members.items():
                z.writestr(n, t)
    (tmp_path / "aisdk-2024-01-07.zip").write_bytes(b"no archive")
    got = landing.read_zipped(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["mmsi"], r["ts_s"], r["lat"], r["rot"], str(r["file_date"])) for r in got] == [(219000001, 1704412810, 55.5, None, "2024-01-05"), (219000001, 1704412820, 55.6, None, "2024-01-05")]
    wrong = {r["file_name"][14:16]: r["error"] for r in landing.problems(spark, str(tmp_path), datetime.date(2024, 1, 4), datetime.date(2024, 1, 9)).collect()}
    assert wrong == {"04": "not found", "06": "one member expected, 2 found", "07": "not a zip archive", "08": "no rows: Empty CSV file", "09": "not found"}
    assert landing.days_between(spark, datetime.date(2024, 1, 2), datetime.date(2024, 1, 1)).count() == 0


def test_the_encoder_attends_to_what_is_there(spark, tmp_path):
    from driftline.operators import encoding

    small = encoding.Config(hidden_size=8, layers=2, heads=2, intermediate_size=12, positions=20)
    model = encoding.Transformer.random(small)
    r = np.random.RandomState(1)
    steps = r.rand(3, 6, 4).astype(np.float32)
    mask = np.array([[1] * 6, [1] * 4 + [0] * 2, [1] + [0] * 5], np.float32)
    whole = model(steps, mask)
    for i in range(3):
        n = int(mask[i].sum())
        assert whole[i] == pytest.approx(model(steps[i : i + 1, :n], np.ones((1, n)))[0], abs=1e-5)
    # one layer by hand, for one head over one row: attention is the value itself
    w, x = model.weights, model.embed(steps[2:, :1])[0, 0]
    for i in range(2):
        y = x + (x @ w[f"{i}.value.w"]) @ w[f"{i}.out.w"]
        y = (y - y.mean()) / np.sqrt(y.var() + small.layer_eps)
        up = y @ w[f"{i}.up.w"]
        up = np.array([u * (1 + math.erf(u / 2**0.5)) / 2 for u in up])
        y = y + up @ w[f"{i}.down.w"]
        x = (y - y.mean()) / np.sqrt(y.var() + small.layer_eps)
    assert whole[2] == pytest.approx(x, abs=1e-4)
    labels = np.full_like(steps, -100.0)
    labels[0, 2] = 0.5
    predicted, loss = model.forward(steps, mask, labels)
    assert loss == pytest.approx(((predicted[0, 2] - 0.5) ** 2).mean())
    assert model.forward(steps)[1] is None
    np.savez(tmp_path / "w.npz", **model.weights)
    again = encoding.Transformer.load(spark, str(tmp_path / "w.npz"), small)
    assert (again(steps, mask) == whole).all()
    with pytest.raises(ValueError, match="shape"):
        encoding.Transformer.load(spark, str(tmp_path / "w.npz"), encoding.Config(hidden_size=4))
    items = spark.createDataFrame([(i, 10 * i, steps[i, : int(mask[i].sum())].tolist()) for i in range(3)], "mmsi int, time_start int, tokens array<array<float>>")
    got = {x["mmsi"]: x["embedding"] for x in encoding.embeddings(items, model, batch_size=2).collect()}
    assert all(got[i] == pytest.approx(whole[i] / np.linalg.norm(whole[i]), abs=1e-5) for i in range(3))
