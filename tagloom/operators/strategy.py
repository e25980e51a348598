"""Planning: which loader reads a file, how much of a remote file to fetch, and which byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom import catalog

MIB = 1024 * 1024
CHUNK = 65536
HEAD = 4 * CHUNK
SMALL_FILE, LARGE_FILE, TAIL = 5 * MIB, 50 * MIB, 16 * MIB
#: Ranged requests that run side by side, tries of each, and milliseconds of waiting per try.
PARALLEL, TRIES, BACK_OFF_MS = 4, 3, 200

#: Factor and step of the places of scattered probes.
SCATTER = (1103515245, 12345)

# Extensions and parts of MIME types per category, asked in this order.
CATEGORIES = {
    "mp4": ("mp4 m4a m4b m4p m4r m4v", "/mp4 m4a m4b"),
    "mpeg": ("mp3 mp2 mp1 aac m2a mpa aacp", "mpeg mp3 /aac aacp"),
    "header-only": ("flac ogg oga ogv opus wav wave aiff aif mkv mka webm mpc mpp wv wvp ape dsf dff asf wma wmv", "flac ogg vorbis opus wav aiff matroska webm musepack wavpack dsf dsdiff asf wma"),
}
PROBES = {"mp4": "mp4Optimized", "mpeg": "headerAndTail", "header-only": "headerOnly", "unknown": "scatter"}


def path_extension(path: Column) -> Column:
    """Lower-case extension after the last dot; null without a dot, or with one only at either end."""
    return F.lower(F.nullif(F.regexp_extract(path, r"^.+\.([^.]+)$", 1), F.lit("")))


def url_extension(url: Column) -> Column:
    """Extension of the last path segment; query and fragment don't count."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return path_extension(F.regexp_extract(bare, r"([^/]*)$", 1))


def mime_essence(mime: Column) -> Column:
    """MIME type without parameters."""
    return F.trim(F.split_part(mime, F.lit(";"), F.lit(1)))


def guess_mime(path: Column) -> Column:
    pairs = [F.lit(x) for kv in catalog.MIME_OF_EXTENSION.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.substring_index(path, ".", -1)))


def dispatch(files: DataFrame, path: str = "file_path", mime: str = "mime_type", can_seek: str | None = None) -> DataFrame:
    """Adds ext, loader, error: the loader by MIME type, else by extension.

    A file without a loader is an error 'CouldNotDetermineFileTypeError'; a
    loader that must seek in a source that can't is 'UnsupportedFileTypeError'.
    """
    reg = catalog.parser_registry(files.sparkSession)
    by_mime = F.broadcast(reg.where("kind = 'mime'").select(F.col("key").alias("_m"), F.col("loader").alias("_ml"), F.col("needs_seek").alias("_ms")))
    by_ext = F.broadcast(reg.where("kind = 'ext'").select(F.col("key").alias("_e"), F.col("loader").alias("_el"), F.col("needs_seek").alias("_es")))
    f = files.withColumn("ext", path_extension(F.col(path)))
    j = f.join(by_mime, mime_essence(F.col(mime)) == F.col("_m"), "left").join(by_ext, F.col("ext") == F.col("_e"), "left")
    found = F.coalesce("_ml", "_el")
    needs = F.when(F.col("_ml").isNotNull(), F.col("_ms")).otherwise(F.col("_es"))
    seek = F.col(can_seek) if can_seek else F.lit(True)
    error = F.when(found.isNull(), "CouldNotDetermineFileTypeError").when(needs & ~seek, "UnsupportedFileTypeError")
    return j.withColumn("error", error).withColumn("loader", F.when(F.col("error").isNull(), found)).drop("_m", "_ml", "_ms", "_e", "_el", "_es")


def sniff(content: Column) -> Column:
    """Loader by the first bytes; an option beside the dispatch, off by default."""
    head = F.hex(F.substring(content, 1, 12))
    rules = [("664C6143", "flac"), ("4F676753", "ogg"), ("4D414320", "apev2"), ("7776706B", "wavpack"), ("44534420", "dsf"), ("46524D38", "dsdiff"), ("3026B275", "asf"), ("1A45DFA3", "matroska"), ("4D502B", "musepack"), ("4D50434B", "musepack"), ("494433", "mpeg"), ("FFF", "mpeg"), ("FFE", "mpeg")]
    found = F.when(F.substring(head, 9, 8) == "66747970", "mp4").when(head.startswith("52494646") & F.substring(head, 17, 8).isin("57415645"), "wav").when(head.startswith("464F524D"), "aiff")
    for mark, loader in rules:
        found = found.when(head.startswith(mark), loader)
    return found


def category(url: Column, mime: Column) -> Column:
    ext, m = F.coalesce(url_extension(url), F.lit("")), F.lower(F.coalesce(mime, F.lit("")))
    found = F
    for name, (exts, parts) in CATEGORIES.items():
        hit = ext.isin(exts.split())
        for p in parts.split():
            hit = hit | F.contains(m, F.lit(p))
        found = found.when(hit, name)
    return found.otherwise("unknown")


def strategy(size: Column, supports_range: Column, cat: Column, small: int = SMALL_FILE) -> Column:
    """fullDownload, headerOnly, probe or randomAccess; an unknown size means a full download."""
    large = F.when(cat == "header-only", "headerOnly").when(size > LARGE_FILE, "randomAccess").otherwise("probe")
    return F.when(size.isNull() | (size <= small) | ~F.coalesce(supports_range, F.lit(False)), "fullDownload").otherwise(large)


def probe_of(cat: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PROBES.items() for x in kv]), cat)


def _down(pos: Column) -> Column:
    return F.floor(pos / CHUNK) * CHUNK


def probe_ranges(size: Column, probe: Column, seed: Column) -> Column:
    """ARRAY<STRUCT<lo, hi>> of the ranges of a probe, not merged; an object of unknown size is read from 0 to its end, a null ``hi``.

    The two scattered probes of an unknown format follow from ``seed``, a long such as a hash of the path, so plans repeat.
    """

    def r(lo: Column, hi: Column, when: Column | None = None) -> Column:
        s = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
        return s if when is None else F.when(when, s)

    zero = F.lit(0)
    head, tail = r(zero, F.least(F.lit(HEAD), size)), r(_down(F.greatest(zero, size - CHUNK)), size, size > HEAD)
    mid = _down(F.floor(size / 2) - CHUNK // 2)
    rnd = [_down(F.pmod(F.pmod(seed, F.lit(1 << 31)) * SCATTER[0] + SCATTER[1] * i, F.greatest(size - 2 * CHUNK, F.lit(1))) + CHUNK) for i in (1, 2)]
    scatter = [head, tail, r(mid, mid + CHUNK, size > 8 * CHUNK), *[r(x, x + CHUNK, size > 16 * CHUNK) for x in rnd]]
    mp4 = [head, r(F.when(size > TAIL, _down(size - TAIL)).otherwise(zero), size)]
    for quarter in (1, 2, 3):
        at = _down(F.floor(size * quarter / 4))
        mp4.append(r(at, F.least(at + CHUNK, size), size > 8 * CHUNK))
    kinds = {"headerOnly": [head], "headerAndTail": [head, tail], "scatter": scatter, "mp4Optimized": mp4, "full": [r(zero, size)]}
    found = F.when(size.isNull(), F.array(r(zero, F.lit(None))))
    for name, ranges in kinds.items():
        found = found.when(probe == name, F.filter(F.array(*ranges), lambda x: x.isNotNull()))
    return found


def merge_ranges(ranges: Column) -> Column:
    """Sorted ranges with overlapping or touching ones merged; a fold inside the row, so nothing is shuffled."""

    def fold(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(acc) > 0) & (x["lo"] <= last["hi"]), grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<lo:bigint,hi:bigint>>"), fold)


def request_batches(ranges: Column) -> Column:
    """ARRAY of batches of at most four requests."""
    n = F.ceil(F.size(ranges) / PARALLEL).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(ranges, i * PARALLEL + 1, PARALLEL))).otherwise(F.array().cast("array<array<struct<lo:bigint,hi:bigint>>>"))


def missing_chunks(lo: Column, hi: Column, cached: Column) -> Column:
    """Numbers of the 64 KiB chunks of [lo, hi) that are not cached."""
    need = F.when(hi > lo, F.sequence(F.floor(lo / CHUNK), F.floor((hi - 1) / CHUNK))).otherwise(F.array().cast("array<bigint>"))
    return F.array_except(need, F.coalesce(cached, F.array().cast("array<bigint>")))


def chunk_islands(chunks: DataFrame, key: str, chunk: str) -> DataFrame:
    """(key, lo, hi, n): runs of neighbouring chunk numbers, one request each; repeated chunks count once.

    Runs are found inside blocks of 4096 chunks and joined across the block
    borders, so a key with very many chunks is not one task.
    """
    c = chunks.select(F.col(key).alias("k"), F.col(chunk).cast("long").alias("c")).where("k IS NOT NULL AND c IS NOT NULL").distinct().withColumn("b", F.shiftright("c", 12))
    w = Window.partitionBy("k", "b").orderBy("c")
    runs = c.withColumn("g", F.col("c") - F.row_number().over(w)).groupBy("k", "b", "g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    # only runs at a border of their block can go on in another one: two of a block at most
    border = (F.pmod("lo", F.lit(4096)) == 0) | (F.pmod("hi", F.lit(4096)) == 4095)
    across = Window.partitionBy("k").orderBy("lo")
    start = F.coalesce((F.col("lo") != F.lag("hi").over(across) + 1).cast("int"), F.lit(1))
    joined = runs.where(border).withColumn("s", start).withColumn("i", F.sum("s").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.where(~border).select("k", "lo", "hi").unionByName(joined.groupBy("k", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("k", "lo", "hi"))
    return whole.select(F.col("k").alias(key), "lo", "hi", (F.col("hi") - F.col("lo") + 1).alias("n"))
