"""The data sources: headers of media files in, documents out."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from wayfold.sources import boxes, documents, headers, sinks

S = 1_000_000


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def movie(created: int, tracks: int = 1) -> bytes:
    head = lambda kind, t: box(kind, bytes(4) + struct.pack(">II", t, t + 1) + bytes(8))
    tracks_ = b"".join(box(b"trak", head(b"tkhd", created + 10 + i) + box(b"mdia", head(b"mdhd", created + 20 + i))) for i in range(tracks))
    return box(b"ftyp", b"isom") + box(b"mdat", bytes(5000)) + box(b"moov", head(b"mvhd", created) + tracks_)


@pytest.fixture()
def folder(tmp_path):
    top = tmp_path / "media"
    (top / "day" / "deep").mkdir(parents=True)
    for i in range(9):
        (top / ("day" if i % 2 else "day/deep") / f"clip{i}.mp4").write_bytes(movie(3_000_000_000 + i, i % 3))
    (top / "broken.MOV").write_bytes(b"\x00\x00\x00\x09moov")
    (top / "notes.txt").write_bytes(b"no media")
    (top / "_hidden").write_bytes(b"x")
    return str(top)


def test_headers_are_read_by_groups_of_files(spark, folder):
    headers.register(spark)
    df = spark.read.format("media_headers").option("files_per_task", 2).load(folder)
    assert df.rdd.getNumPartitions() == 6
    good = df.filter("extension = '.mp4'")
    want = {(r["path"].split("media/")[1], r["box"], int(r["created"]), int(r["modified"])) for r in boxes.header_timestamps(spark, f"{folder}/day/*.mp4").unionByName(boxes.header_timestamps(spark, f"{folder}/day/deep")).collect()}
    assert {(r["path"].split("media/")[1], r["box"], int(r["created"]), int(r["modified"])) for r in good.collect()} == want and len(want) == 9 + 2 * sum(i % 3 for i in range(9))
    bad = {r["path"].rsplit("/", 1)[1] for r in df.filter("error IS NOT NULL").collect()}
    assert bad == {"broken.MOV", "notes.txt"}
    assert spark.read.format("media_headers").load(f"{folder}/day/clip1.mp4").filter("box = 'mvhd'").count() == 1


def test_files_that_a_filter_rules_out_are_not_opened(spark, folder):
    headers.register(spark)
    df = spark.read.format("media_headers").option("files_per_task", 1).load(folder)
    deep = df.filter("contains(path, '/deep/') AND extension = '.mp4'")
    assert deep.rdd.getNumPartitions() == 5 and deep.select("path").distinct().count() == 5
    os.chmod(f"{folder}/notes.txt", 0)
    assert df.filter("extension IN ('.mp4', '.mov') AND created >= 3000000005").filter("box = 'mvhd'").count() == 4
    assert df.filter("startswith(path, '/nowhere')").count() == 0


def points(spark, n=40, clips=3):
    rows = [(f"s{c % 2}", c, (i if i < 20 else i + 5) * S, 1_700_000_000 * S + i * S, -33.5 + i / 1000, 151.0 + c, 10.0 + i / 8 if i % 4 else None) for c in range(clips) for i in range(n)]
    rows.append(("s0", 0, 999 * S, 1_700_000_999 * S, None, None, None))
    return spark.createDataFrame(rows, "series_id string, clip_id int, pts long, stamp long, lat double, lon double, elevation double").repartition(7)


def read(path):
    return {f: open(f"{path}/{f}", encoding="utf-8").read() for f in os.listdir(path) if not f.startswith(".")}


def test_documents_of_points_and_cues(spark, tmp_path):
    p = points(spark)
    name = F.concat_ws("-", "series_id", F.col("clip_id").cast("string"))
    whole = {f"{r['series_id']}-{r['clip_id']}.gpx": r["text"] for r in sinks.gpx_documents(p.filter("lat IS NOT NULL"), S).collect()}
    assert documents.write(sinks.gpx_pieces(p.filter("lat IS NOT NULL"), S, name), str(tmp_path / "gpx"), ".gpx") is False
    assert read(tmp_path / "gpx") == whole and len(whole) == 3 and whole["s0-0.gpx"].count("<trkseg>") == 2
    documents.write(sinks.cue_pieces(sinks.dji_cues(p, S), name), str(tmp_path / "dji"), ".srt")
    text = read(tmp_path / "dji")["s0-0.srt"]
    cues = text.rstrip("\n").split("\n\n")
    assert len(cues) == 40 and cues[1] == '2\n00:00:01,000 --> 00:00:02,000\n<font size="28">FrameCnt: 2, DiffTime: 1000ms 2023-11-14 22:13:21.000 [latitude: -33.499000] [longitude: 151.000000] [rel_alt: 0.000 abs_alt: 10.125] </font>'
    assert cues[0].endswith("[rel_alt: 0.000 abs_alt: 0.000] </font>") and cues[19].split("\n")[1] == "00:00:19,000 --> 00:00:25,000"
    documents.write(sinks.cue_pieces(sinks.srt_cues(p.filter("clip_id = 1"), F.lit("x"), S), name), str(tmp_path / "srt"), ".srt")
    assert list(read(tmp_path / "srt")) == ["s1-1.srt"] and read(tmp_path / "srt")["s1-1.srt"].startswith("1\n00:00:00,000 --> 00:00:01,000\nx\n\n2\n")


def test_replacing_and_adding_documents(spark, tmp_path):
    out = str(tmp_path / "out")
    df = lambda *rows: spark.createDataFrame(list(rows), "document string, ord long, text string")
    documents.write(df(("a", 2, "two"), ("a", 1, "one "), ("b", 1, None)), out)
    assert read(out) == {"a": "one two", "b": ""}
    assert documents.write(df(("c", 1, "three")), out, overwrite=False) is True and read(out) == {"a": "one two", "b": "", "c": "three"}
    with pytest.warns(UserWarning, match="replacing"):
        documents.write(df(("d", 1, "é")), out)
    assert read(out) == {"d": "é"}
    documents.write(df(), str(tmp_path / "none"))
    assert not os.path.isdir(tmp_path / "none") or read(tmp_path / "none") == {}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(f"d{i}", j, "line\n") for i in range(8) for j in range(50)]
    documents.write(spark.createDataFrame([("old", 1, "kept")], "document string, ord long, text string"), out)
    df = spark.createDataFrame(rows, "document string, ord long, text string")
    failing = df.withColumn("text", F.when((F.col("document") == "d5") & (F.col("ord") == 49), F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"), pytest.warns(UserWarning):
        documents.write(failing, out)
    assert os.listdir(out) == ["old"] and read(out) == {"old": "kept"}
    with pytest.raises(Exception, match="plain name"), pytest.warns(UserWarning):
        documents.write(df.withColumn("document", F.lit("../up")), out)
    assert os.listdir(out) == ["old"]
