"""Chapter ends, titles and sample tables: leads, running sums, range joins and as-of joins.

Running values and as-of joins work in blocks with a carry
(:mod:`tagloom.operators.running`), and leads in buckets
(:mod:`tagloom.operators.intervals`), so no track or file is one task and no
pairs are formed inside one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.intervals import next_point
from tagloom.operators.running import dense_ranks, in_force, running_sums

# Clocks a chapter list may count in.
CLOCKS = [1000, 22050, 44100, 48000, 90000, 1000000, 10000000]


def chapter_ends(chapters: DataFrame, key: str = "file_id", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """(key, start, title, until): a chapter ends at its own end, else at the next later start, else nowhere.

    Repeated rows count once; rows without key or start are left out.
    """
    c = chapters.select(key, start, "title", end).where(F.col(key).isNotNull() & F.col(start).isNotNull()).distinct()
    follow = next_point(c.select(key, start).distinct(), key, start, "later")
    return c.join(follow, [key, start]).select(key, start, "title", F.coalesce(end, "later").alias("until"))


def clamp_end(start: Column, end: Column, fallback: Column) -> Column:
    """An end before its start falls back to the file's duration, else to the start."""
    return F.when(end >= start, end).when(fallback >= start, fallback).otherwise(start)


def default_titles(chapters: DataFrame, key: str, start: str, prefix: str = "Chapter ") -> DataFrame:
    """Adds n (rank of the start in the key, from 1) and fills empty titles with the prefix and n."""
    ranked = dense_ranks(chapters, key, start, "n")
    return ranked.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit(prefix), F.col("n").cast("string"))))


def running_offsets(stts: DataFrame, track: str, idx: str, count: str, duration: str) -> DataFrame:
    """Adds first_sample, last_sample (from 0, last excluded) and first_time of each stts entry."""
    span = F.col(count).cast("long")
    summed = running_sums(stts, [track], idx, {"first_sample": span, "first_time": span * F.col(duration)})
    return summed.withColumn("last_sample", F.col("first_sample") + span)


def _entry(stts: DataFrame, track: str, idx: str, count: str, duration: str) -> tuple[DataFrame, Column]:
    """Entries with samples, and what they say, for an as-of join."""
    r = running_offsets(stts, track, idx, count, duration).where("last_sample > first_sample")
    return r, F.struct("first_sample", "last_sample", "first_time", F.col(duration).cast("long").alias("d"))


def sample_times(samples: DataFrame, stts: DataFrame, track: str, sample: str, idx: str, count: str, duration: str) -> DataFrame:
    """(track, sample, time): start of each sample; null beyond the table."""
    r, entry = _entry(stts, track, idx, count, duration)
    e = F.col("e")
    time = F.when(F.col(sample) < e["last_sample"], e["first_time"] + (F.col(sample) - e["first_sample"]) * e["d"])
    return in_force(samples, r, track, sample, "first_sample", entry, "e").select(track, sample, time.alias("time"))


def samples_per_chunk(chunks: DataFrame, stsc: DataFrame, track: str, chunk: str, first_chunk: str, per_chunk: str) -> DataFrame:
    """(track, chunk, n): the stsc entry in force at each chunk; the last entry has no end, and holds before the first one too."""
    last = stsc.groupBy(track).agg(F.max_by(per_chunk, first_chunk).alias("_last"))
    found = in_force(chunks, stsc, track, chunk, first_chunk, F.col(per_chunk), "n")
    return found.join(last, track).select(track, chunk, F.coalesce("n", "_last").alias("n"))


def chunk_before(points: DataFrame, chunks: DataFrame, track: str, at: str, offset: str, number: str) -> DataFrame:
    """(track, at, number): as-of join, the last chunk that starts before ``at``, else chunk 1."""
    found = in_force(points, chunks, track, at, offset, F.col(number).cast("long"), "_n", inclusive=False)
    return found.select(track, at, F.coalesce("_n", F.lit(1)).alias(number))


def chunk_durations(chunks: DataFrame, stts: DataFrame, track: str, chunk: str, per_chunk: str, idx: str, count: str, duration: str) -> DataFrame:
    """(track, chunk, time): time before each chunk: the entry in force at the samples before it, and what lies before that entry."""
    starts = running_sums(chunks, [track], chunk, {"_s": F.col(per_chunk).cast("long")})
    r, entry = _entry(stts, track, idx, count, duration)
    e = F.col("e")
    timed = in_force(starts, r, track, "_s", "first_sample", entry, "e").select(track, "_s", (e["first_time"] + (F.least("_s", e["last_sample"]) - e["first_sample"]) * e["d"]).alias("time"))
    return starts.join(timed, [track, "_s"]).select(track, chunk, "time")


def time_base(largest: Column, seconds: Column) -> Column:
    """Clock of a chapter list: largest stamp over duration, snapped to a usual clock within 2 %."""
    inferred = F.round(largest / seconds).cast("long")
    err = [F.struct((F.abs(F.lit(c) - inferred) / inferred).alias("e"), F.lit(i).alias("i"), F.lit(c).cast("long").alias("c")) for i, c in enumerate(CLOCKS)]
    best = F.array_min(F.array(*err))
    return F.when((largest > 0) & (seconds > 0) & (inferred > 0), F.when(best["e"] <= 0.02, best["c"]).otherwise(inferred))


def toc_order(toc: DataFrame, chap: DataFrame, key: str, pos: str, child: str, label: str) -> DataFrame:
    """Chapters in the order of the table of contents, by label; ids without a chapter are skipped."""
    return toc.alias("t").join(chap.alias("c"), (F.col(f"t.{key}") == F.col(f"c.{key}")) & (F.col(f"t.{child}") == F.col(f"c.{label}"))).select(F.col(f"t.{key}").alias(key), F.col(f"t.{pos}").alias(pos), F.col(f"c.{label}").alias(label), "c.title", "c.start_ms")


def vorbis_chapters(comments: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, n, start_ms, title, end_ms) from CHAPTERnnn and CHAPTERnnnNAME comments; malformed stamps are dropped."""
    num = F.regexp_extract(F.upper(name), r"^CHAPTER(\d+)(NAME)?$", 1)
    is_name = F.upper(name).rlike(r"^CHAPTER\d+NAME$")
    rx = r"^(\d+):(\d{2}):(\d{2})(?:\.(\d{1,3}))?$"
    h, m, s, f = (F.regexp_extract(F.trim(value), rx, i) for i in (1, 2, 3, 4))
    ms = F.when(h != "", ((h.cast("long") * 60 + m.cast("long")) * 60 + s.cast("long")) * 1000 + F.coalesce(F.rpad(F.nullif(f, F.lit("")), 3, "0").cast("long"), F.lit(0)))
    c = comments.select(F.col(key).alias("k"), num.alias("num"), is_name.alias("nm"), F.col(value).alias("v"), ms.alias("ms")).where("num <> ''")
    got = c.groupBy("k", F.col("num").cast("int").alias("n")).agg(F.max(F.when(~F.col("nm"), F.col("ms"))).alias("start_ms"), F.max(F.when(F.col("nm"), F.col("v"))).alias("title")).where("start_ms IS NOT NULL")
    titled = got.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Chapter "), F.col("n").cast("string"))))
    return titled.select(F.col("k").alias(key), "n", "start_ms", "title", F.lead("start_ms").over(Window.partitionBy("k").orderBy("start_ms", "n")).alias("end_ms"))


def best_track(tracks: DataFrame, key: str, is_default: str, number: str, fields: list[str]) -> DataFrame:
    """The default track, else the one with the lowest number."""
    return tracks.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct((~F.col(is_default)).alias("d"), F.col(number).alias("n"))).alias("t")).select(key, "t.*")
