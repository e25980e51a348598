import builders as B
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.operators import resolve as R
from tagloom.sources import audio as A
from tagloom.sources import remote


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.flac").write_bytes(B.flac(["TITLE=Song", "ARTIST=Band", "DATE=2001-02-03"]))
    (tmp_path / "b.mp3").write_bytes(B.id3v2([("TIT2", b"\x03Other")]) + B.mpeg_frames() + B.id3v1())
    (tmp_path / "c.xyz").write_bytes(b"nothing")
    (tmp_path / "d.flac").write_bytes(b"broken")
    return str(tmp_path)


def test_read_audio_to_normalized_record(spark, folder):
    got = A.read_audio(spark, folder)
    names = A.scan_files(spark, folder).select("file_id", F.element_at(F.split("file_path", "/"), -1).alias("f"))
    rec = R.normalized(R.map_tags(R.tag_values(A.tag_events(got))), ["title", "artist", "year"], ["genre"]).join(names, "file_id")
    rows = {r["f"]: r for r in rec.collect()}
    assert rows["a.flac"]["title"] == "Song" and rows["a.flac"]["year"] == "2001"
    assert rows["b.mp3"]["title"] == "Other" and rows["b.mp3"]["artist"] == "A" and rows["b.mp3"]["genre"] == ["Pop"]
    errors = {(r["name"]) for r in A.quality(got).where("kind = 'error'").collect()}
    assert errors == {"CouldNotDetermineFileTypeError", "UnexpectedFileContentError"}


def test_size_limit_reaches_the_scan(spark, folder):
    plan = A.scan_files(spark, folder, 5)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(length,5)" in plan


def test_failfast(spark, folder):
    with pytest.raises(Exception, match="no loader|fLaC mark"):
        A.read_audio(spark, folder, mode="FAILFAST").collect()


def test_data_source(spark, folder):
    remote.register(spark)
    df = spark.read.format("audio").option("path", folder).option("preset", "all").load()
    assert df.where("kind = 'tag' AND tag_id = 'TITLE'").select("v_str").collect()[0][0] == "Song"
    assert df.where("kind = 'error'").count() == 2


def test_data_source_reads_large_files_to_the_end(spark, tmp_path):
    """Tags behind the audio data and durations of files over 5 MiB, with the default strategy."""
    import struct

    data = bytes(6 << 20)
    body = B.chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, 44100, 176400, 4, 16)) + B.chunk(b"data", data) + B.chunk(b"LIST", b"INFO" + B.chunk(b"INAM", b"Late"))
    (tmp_path / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    short = B.vorbis(["TITLE=Long"])
    pages = short[: short.rindex(b"OggS")] + b"".join(B.ogg_page(1, 4 * (g == 100), g * 441000, [bytes(60000)]) for g in range(1, 101))
    (tmp_path / "b.ogg").write_bytes(pages)
    assert len(pages) > 5 << 20
    remote.register(spark)
    rows = spark.read.format("audio").option("path", str(tmp_path)).option("preset", "all").load().collect()
    assert [r["v_str"] for r in rows if r["kind"] == "tag" and r["tag_id"] == "INAM"] == ["Late"]
    last = {r["path"].rpartition("/")[2]: r["v_dbl"] for r in rows if r["kind"] == "format" and r["tag_id"] == "duration"}
    assert last["a.wav"] == len(data) // 4 / 44100
    assert last["b.ogg"] == 1000.0


def test_stream_of_chunks(spark, tmp_path):
    from tagloom.streaming.assembly import decode_stream

    whole = B.id3v2([("TIT2", b"\x03Live")])
    parts = [whole[:5], whole[5:12], whole[12:]]
    src = str(tmp_path / "in")
    schema = "stream_id long, chunk_no int, is_last boolean, data binary, loader string"
    rows = [(1, i, i == 2, p, "id3v2") for i, p in enumerate(parts)] + [(1, 0, False, parts[0], "id3v2"), (2, 0, False, parts[0], "id3v2")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    q = decode_stream(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("decoded").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
        got = spark.sql("SELECT stream_id, v_str FROM decoded WHERE kind = 'tag'").collect()
    finally:
        q.stop()
    assert [tuple(r) for r in got] == [(1, "Live")]
