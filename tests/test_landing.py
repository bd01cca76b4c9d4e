"""Archives of all kinds of damage: each is named, and nothing else is lost."""

import datetime
import io
import zipfile

from driftline import jobs
from driftline.sources import landing

HEAD = "# Timestamp,MMSI,Latitude,Longitude,Navigational status,ROT,SOG,COG,Heading,Ship type\n"


def line(day, s, mmsi=219000001, status="Moored"):
    return f"{day:02}/01/2024 00:00:{s:02},{mmsi},55.5,10.5,{status},,5.0,90.0,91,Cargo\n"


def archive(*members, stored=False):
    at = io.BytesIO()
    with zipfile.ZipFile(at, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for i, text in enumerate(members):
            z.writestr(f"{i}.csv", text)
    return at.getvalue()


def flipped(raw, share):
    """One byte of the member's data is another."""
    data = bytearray(raw)
    at = 35 + int((raw.index(b"PK\x01\x02") - 40) * share)
    data[at] ^= 0xFF
    return bytes(data)


def test_every_damage_is_named_and_the_other_days_are_read(spark, tmp_path):
    many = [HEAD + "".join(line(d, i % 60) for i in range(500)) for d in range(32)]
    given = {
        1: archive(many[1]),
        2: flipped(archive(many[2]), 0.5),
        3: flipped(archive(many[3], stored=True), 0.5),
        4: archive(HEAD + line(4, 0) + "04/01/2024 00:00:01,219000001,55.5\n" + line(4, 2) + line(4, 3)[:-1] + ",more,and more\n"),
        5: archive(many[5], many[5]),
        6: archive(""),
        7: b"",
        8: archive(many[8])[:-30],
        9: archive((HEAD + line(9, 1, status="Mo\xf8red")).encode("latin-1")),
        10: archive(HEAD),
        11: archive(),
        12: archive("MMSI,Latitude\n219000001,55.5\n"),
    }
    for day, raw in given.items():
        (tmp_path / f"aisdk-2024-01-{day:02}.zip").write_bytes(raw)
    rows = landing.read_zipped(spark, str(tmp_path)).groupBy("file_date").count().collect()
    assert {r["file_date"].day: r["count"] for r in rows} == {1: 500, 4: 2, 9: 1, 12: 1}
    text = landing.read_zipped(spark, str(tmp_path)).filter("day(file_date) = 9").first()["nav_text"]
    assert text == "Mo�red"
    wrong = {}
    for r in landing.problems(spark, str(tmp_path), datetime.date(2024, 1, 1), datetime.date(2024, 1, 13)).collect():
        wrong.setdefault(int(r["file_name"][14:16]), []).append(r["error"])
    assert set(wrong) == {2, 3, 4, 5, 6, 7, 8, 11, 13}
    assert "can't be read" in wrong[2][0]
    assert "can't be read" in wrong[3][0]
    assert wrong[4] == ["2 rows of another width"]
    assert wrong[5] == ["one member expected, 2 found"]
    assert wrong[6][0].startswith("no rows")
    assert wrong[8] == ["not a zip archive"]
    assert wrong[11] == ["one member expected, 0 found"]
    # Spark passes over files of no bytes
    assert wrong[7] == wrong[13] == ["not found"]


def test_the_job_goes_on_beside_a_broken_archive(spark, tmp_path):
    (tmp_path / "zip").mkdir()
    good = HEAD + "".join(line(5, i) for i in range(60))
    (tmp_path / "zip" / "aisdk-2024-01-05.zip").write_bytes(archive(good))
    (tmp_path / "zip" / "aisdk-2024-01-06.zip").write_bytes(flipped(archive(good), 0.6))
    jobs.main(["unzip", str(tmp_path / "zip"), str(tmp_path / "in")])
    assert spark.read.parquet(str(tmp_path / "in" / "messages")).count() == 60
    assert [r["file_name"] for r in spark.read.parquet(str(tmp_path / "in" / "problems")).collect()] == ["aisdk-2024-01-06.zip"]
