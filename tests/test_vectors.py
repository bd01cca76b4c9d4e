"""Archives of vectors: a round trip, broken archives, and what a failed write leaves."""

import os

import numpy as np
import pytest

from driftline.sources import vectors


def frame(spark, n=1000, dims=8):
    x = np.random.RandomState(2).rand(n, dims).astype(np.float32)
    return x, spark.createDataFrame([(i, [float(v) for v in p], 219000000 + i % 7, 1704067200 + i) for i, p in enumerate(x)], "vec_id long, embedding array<float>, mmsi int, start_time int").repartition(3)


def test_round_trip_and_overwrite(spark, tmp_path):
    x, rows = frame(spark)
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        vectors.write_npz(rows, str(tmp_path / "v"), mode)
        names = os.listdir(tmp_path / "v")
        assert len(names) == 3 * times
        assert all(n.endswith(".npz") for n in names)
        got = vectors.read_npz(spark, str(tmp_path / "v")).collect()
        assert len(got) == 1000 * times
        assert {r["start_time"]: tuple(r["embedding"]) for r in got} == {1704067200 + i: tuple(p) for i, p in enumerate(x.tolist())}
        assert {r["mmsi"] for r in got} == {219000000 + i for i in range(7)}
    assert {r["error"] for r in got} == {None}


def test_published_and_broken_archives(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.savez_compressed(tmp_path / "a.npz", embeddings=x, mmsis=np.arange(4), start_times=np.arange(4) * 10)
    np.savez(tmp_path / "b.npz", embeddings=x)
    np.savez(tmp_path / "c.npz", embeddings=x, mmsis=np.arange(3), start_times=np.arange(4))
    np.savez(tmp_path / "d.npz", embeddings=np.array([{"a": 1}], object), mmsis=np.arange(1), start_times=np.arange(1))
    np.savez(tmp_path / "e.npz", embeddings=np.zeros((0, 3)), mmsis=np.arange(0), start_times=np.arange(0))
    whole = (tmp_path / "a.npz").read_bytes()
    (tmp_path / "f.npz").write_bytes(whole[:80] + bytes([whole[80] ^ 255]) + whole[81:])
    (tmp_path / "g.npz").write_bytes(b"nothing")
    got = vectors.read_npz(spark, str(tmp_path)).collect()
    assert [(r["row"], r["mmsi"], r["start_time"], r["embedding"]) for r in sorted((r for r in got if r["error"] is None), key=lambda r: r["row"])] == [(i, i, 10 * i, x[i].tolist()) for i in range(4)]
    wrong = {r["file_name"]: r["error"] for r in got if r["error"] is not None}
    assert set(wrong) == {f"{c}.npz" for c in "bcdfg"}
    assert wrong["b.npz"] == "arrays are missing: mmsis, start_times"
    assert wrong["c.npz"].startswith("shapes don't fit")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0] * (3 if i < 90 else 4), 1, i) for i in range(100)], "vec_id long, embedding array<float>, mmsi long, start_time long").repartition(4)
    with pytest.raises(Exception, match="one length"):
        vectors.write_npz(rows, str(tmp_path / "v"))
    left = [f for d, _, fs in os.walk(tmp_path / "v") for f in fs if f.endswith(".npz")]
    assert left == []
    with pytest.raises(Exception, match="missing"):
        rows.drop("mmsi").write.format("npz_vectors").mode("append").save(str(tmp_path / "w"))
