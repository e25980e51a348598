"""Operators with nulls, ties, repeated rows, empty tables and clashing columns."""

import random

from pyspark.sql import functions as F

from tagloom.functions import lyrics as LY
from tagloom.functions import normalize as N
from tagloom.operators import chapters as C
from tagloom.operators import resolve as R
from tagloom.operators import strategy as S

EVENTS = "file_id long, seq int, format_id string, tag_id string, v_str string, v_list array<string>, v_int long, v_bool boolean"


def simulate(rows):
    """Restatement of the accept, replace and append loop for titles and artists."""
    from tagloom.catalog import PRIORITY, tag_map_rows

    names = {(f, n): c for f, n, c in tag_map_rows()}
    state, changes = {}, []
    for f, seq, fmt, tag, v, *_ in sorted(rows, key=lambda r: (r[0], r[1])):
        common = names.get((fmt, tag.lower()))
        if common not in ("title", "artist"):
            continue
        p = PRIORITY.get(fmt, 0)
        cur = state.get((f, common))
        if cur and (p < cur[0] or common == "artist" and cur[1] == fmt):
            continue
        state[f, common] = (p, fmt, v)
        changes.append((f, common, seq, v))
    return {k: v[2] for k, v in state.items()}, set(changes)


def test_merge_follows_the_loop(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 8)
    rng = random.Random(3)
    native = {"ID3v1": ("title", "artist"), "ID3v2.3": ("TIT2", "TPE1"), "ID3v2.4": ("tit2", "TPE1"), "vorbis": ("TITLE", "artist"), "iTunes": ("©nam", "©ART")}
    rows = []
    for f in range(40):
        for seq in range(rng.randint(1, 30)):
            fmt = rng.choice(list(native))
            rows.append((f, seq, fmt, rng.choice(native[fmt]), f"v{rng.randint(0, 9)}", None, None, None))
    mapped = R.map_tags(R.tag_values(spark.createDataFrame(rows + rows[:50], EVENTS)))
    state, changes = simulate(rows)
    got = {(r["file_id"], r["common_id"]): r["value"] for r in R.merge_singletons(mapped).where("common_id = 'title'").collect()}
    got |= {(r["file_id"], "artist"): r["value"] for r in R.merge_artist(mapped).collect()}
    assert got == state
    assert {tuple(r) for r in R.accepted_changes(mapped).where("common_id IN ('title', 'artist')").collect()} == changes


def test_lists_and_dates(spark):
    rows = [(1, 0, "vorbis", "GENRE", None, ["a", "", "b"], None, None), (1, 1, "vorbis", "genre", "b", None, None, None), (1, 2, "ID3v2.4", "TCON", None, ["x", "y"], None, None), (1, 3, "ID3v2.3", "TCON", "z", None, None, None), (1, 4, "vorbis", "DATE", "2001-02", None, None, None), (1, 5, "vorbis", "ENCODED", None, None, None, None), (None, 6, "vorbis", "TITLE", "t", None, None, None)]
    v = R.tag_values(spark.createDataFrame(rows, EVENTS))
    m = R.map_tags(v)
    assert R.merge_lists(m).collect()[0]["vals"] == ["x", "y"]
    assert {(r["common_id"], r["value"]) for r in R.merge_singletons(m).collect()} == {("date", "2001-02"), ("year", "2001")}
    assert R.unmapped_tags(v).count() == 0
    empty = R.map_tags(R.tag_values(spark.createDataFrame([], EVENTS)))
    assert R.merge_singletons(empty).count() == R.merge_artist(empty).count() == R.merge_lists(empty).count() == 0


def test_ranges(spark):
    df = spark.sql("SELECT * FROM VALUES (100L), (300000L), (2000000L), (40000000L) AS t(size)")
    rows = df.select("size", S.merge_ranges(S.probe_ranges(F.col("size"), F.lit("scatter"), F.xxhash64(F.lit("u")))).alias("r")).collect()
    for r in rows:
        assert r["r"][0]["lo"] == 0 and r["r"][-1]["hi"] == r["size"]
        assert all(a["hi"] < b["lo"] for a, b in zip(r["r"], r["r"][1:]))
    assert [len(r["r"]) for r in rows][:2] == [1, 1]
    batches = df.limit(1).select(S.request_batches(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct(i.cast("long").alias("lo"), i.cast("long").alias("hi"))))).collect()[0][0]
    assert [len(b) for b in batches] == [4, 4, 1]


def test_islands_across_blocks(spark):
    df = spark.createDataFrame([("a", c) for c in [*range(4090, 4105), 5000, 5000, 12288, 12287]] + [("b", None), (None, 1)], "k string, chunk long")
    got = {(r["lo"], r["hi"]) for r in S.chunk_islands(df, "k", "chunk").collect()}
    assert got == {(4090, 4104), (5000, 5000), (12287, 12288)}


def test_dispatch_and_extensions(spark):
    df = spark.createDataFrame([("a.MP3", None), ("x/y.flac", "audio/ogg; q=1"), ("noext", None), (".hidden", None), ("dot.", None), (None, None)], "file_path string, mime_type string")
    got = [(r["ext"], r["loader"], r["error"]) for r in S.dispatch(df).collect()]
    assert sorted(got, key=str) == sorted([("mp3", "mpeg", None), ("flac", "ogg", None)] + [(None, None, "CouldNotDetermineFileTypeError")] * 4, key=str)
    url = spark.sql("SELECT 'https://h.x/a/b.M4B?v=1.2#z.q' AS u").select(S.url_extension(F.col("u")), S.category(F.col("u"), F.lit(None).cast("string"))).collect()[0]
    assert tuple(url) == ("m4b", "mp4")


def test_scalars(spark):
    r = spark.sql("SELECT ' 3/12 ' AS t, '0x1F' AS h, '1999-1' AS d, '99' AS s, cast(null AS string) AS n").select(
        N.position(F.col("t")), N.total(F.col("t")), N.whole_int(F.col("h")), N.year_of(F.col("d")), N.year_of(F.col("s")), N.year_of(F.col("n")), N.stars(F.lit(0.5)), N.to_bool(F.lit("YES")), N.total(F.lit("1/0"), True)
    ).collect()[0]
    assert tuple(r) == (3, 12, None, 1999, None, None, 3, True, None)


def test_lyrics(spark):
    r = spark.createDataFrame([("[la:en]\n[00:12.34][00:20.00]a\r\n[01:00.123] b\nno",), ("plain ",), (None,)], "t string").select(LY.synced_lines(F.col("t")).alias("s"), LY.unsynced_text(F.col("t")).alias("u")).collect()
    assert [(x["ms"], x["text"]) for x in r[0]["s"]] == [(12340, "a"), (60123, "b")] and r[0]["u"] is None and r[1]["u"] == "plain"


def test_chapter_helpers(spark):
    c = spark.createDataFrame([(1, 0, None, None), (1, 5, "x", 9), (1, 5, "x", 9), (2, None, "y", 3)], "file_id long, start_ms long, title string, end_ms long")
    assert {(r["start_ms"], r["until"]) for r in C.chapter_ends(c).collect()} == {(0, 5), (5, 9)}
    assert C.chapter_ends(c.limit(0)).count() == 0
    t = spark.sql("SELECT 1").select(C.time_base(F.lit(4410000.0), F.lit(100.2)), C.time_base(F.lit(0.0), F.lit(5.0)), C.clamp_end(F.lit(5), F.lit(3), F.lit(9))).collect()[0]
    assert tuple(t) == (44100, None, 9)


def test_vorbis_chapters_of_long_files(spark, tmp_path):
    """More than 999 chapters, and starts from 100 hours on."""
    from tagloom.plans import planning

    starts = [(1, 1000 * i, f"t{i}") for i in range(1200)] + [(1, 360_000_000, "late"), (1, 4_000_000_000, "later")]
    spark.createDataFrame(starts, "file_id long, start_ms long, title string").write.parquet(str(tmp_path / "chap.parquet"))
    got = sorted((r["n"], r["start_ms"], r["title"], r["end_ms"]) for r in planning.vorbis_chapters(spark, str(tmp_path)).collect())
    ends = [s[1] for s in starts[1:]] + [None]
    assert got == [(i + 1, s[1], s[2], e) for i, (s, e) in enumerate(zip(starts, ends))]
