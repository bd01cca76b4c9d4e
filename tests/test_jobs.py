import zipfile

import numpy as np

from driftline import jobs
from driftline.operators import encoding


def test_reports_become_voyages_and_splits(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    lines = ["# Timestamp,MMSI,Latitude,Longitude,Navigational status,ROT,SOG,COG,Heading,Ship type"]
    for v in range(4):
        for i in range(80):
            s = 300 * i
            lines.append(f"05/01/2024 {s // 3600:02}:{s % 3600 // 60:02}:00,{219000000 + v},{55 + 0.01 * i:.4f},10.5,Moored,0,8.0,10.0,11,Cargo")
    (tmp_path / "csv" / "aisdk-2024-01-05.csv").write_text("\n".join(lines) + "\n")
    jobs.main(["ingest", str(tmp_path / "csv"), str(tmp_path / "in")])
    jobs.main(["voyages", str(tmp_path / "in"), str(tmp_path / "voyages")])
    jobs.main(["split", str(tmp_path / "voyages"), str(tmp_path / "split"), "--val", "0.25", "--test", "0.25"])
    counted = {r["counter"]: r["value"] for r in spark.read.parquet(str(tmp_path / "voyages_counters")).collect()}
    assert (counted["num_segments"], counted["num_messages"], counted["num_final_voyages"], counted["num_final_rows"]) == (4, 320, 4, 4 * 79)
    steps = spark.read.parquet(str(tmp_path / "split"))
    assert steps.count() == 4 * 79
    assert {r["split"] for r in steps.select("split").distinct().collect()} == {"train", "val", "test"}
    assert spark.read.parquet(str(tmp_path / "in" / "vessel_types")).filter("vessel_type = 70").count() == 4
    assert spark.read.parquet(str(tmp_path / "in" / "vessel_types_daily")).count() == 4
    np.savez(tmp_path / "weights.npz", **encoding.Transformer.random(encoding.Config()).weights)
    jobs.main(["embeddings", str(tmp_path / "voyages"), str(tmp_path / "vectors"), "--weights", str(tmp_path / "weights.npz"), "--archives", str(tmp_path / "archives")])
    from driftline.sources.vectors import read_npz

    kept = {tuple(r["embedding"]) for r in read_npz(spark, str(tmp_path / "archives")).collect()}
    assert kept == {tuple(r["embedding"]) for r in spark.read.parquet(str(tmp_path / "vectors")).collect()}
    assert {len(r["embedding"]) for r in spark.read.parquet(str(tmp_path / "vectors")).collect()} == {256}


def test_archives_become_messages(spark, tmp_path):
    (tmp_path / "zip").mkdir()
    with zipfile.ZipFile(tmp_path / "zip" / "aisdk-2024-01-05.zip", "w") as z:
        z.writestr("a.csv", "# Timestamp,MMSI,Latitude,Longitude,Navigational status,ROT,SOG,COG,Heading,Ship type\n05/01/2024 00:00:10,219000001,55.5,10.5,Moored,,5.0,90.0,91,Cargo\n")
    jobs.main(["unzip", str(tmp_path / "zip"), str(tmp_path / "in"), "--first", "2024-01-05", "--last", "2024-01-06"])
    assert spark.read.parquet(str(tmp_path / "in" / "messages")).count() == 1
    assert [r["file_name"] for r in spark.read.parquet(str(tmp_path / "in" / "problems")).collect()] == ["aisdk-2024-01-06.zip"]


def test_vectors_become_labels(spark, tmp_path):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.random.RandomState(1).rand(50, 3))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    jobs.main(["cluster", str(tmp_path / "v"), str(tmp_path / "out"), "--clusters", "3", "--sample-size", "20"])
    assert {r["label"] for r in spark.read.parquet(str(tmp_path / "out" / "labels")).collect()} == {0, 1, 2}
    drawn = spark.read.parquet(str(tmp_path / "out" / "dendrogram")).orderBy("step").collect()
    assert drawn[-1]["size"] <= 20
    assert [r["dist"] for r in drawn] == sorted(r["dist"] for r in drawn)
    jobs.main(["cluster", str(tmp_path / "v"), str(tmp_path / "out"), "--clusters", "3", "--sample-size", "20", "--dendrogram-p", "4"])
    few = spark.read.parquet(str(tmp_path / "out" / "dendrogram")).orderBy("step").collect()
    assert [tuple(r)[1:] for r in few] == [tuple(r)[1:] for r in drawn[-4:]]
    np.savez(tmp_path / "v.npz", embeddings=np.array([v for _, v in rows]), mmsis=np.arange(50), start_times=np.arange(50))
    jobs.main(["cluster", str(tmp_path / "v.npz"), str(tmp_path / "out2"), "--clusters", "3", "--sample-size", "20"])
    assert spark.read.parquet(str(tmp_path / "out2" / "labels")).count() == 50
