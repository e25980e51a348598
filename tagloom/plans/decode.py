"""Queries of the byte decoders: containers are built from table rows with Column expressions, decoded, and compared with the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions import binary as B
from tagloom.operators import resolve as R
from tagloom.operators.strategy import sniff
from tagloom.plans import samples
from tagloom.session import table
from tagloom.sources import audio as A
from tagloom.sources import ranges
from tagloom.sources.decode.events import Options

_c = F.col


def _safe(n: Column) -> Column:
    """Four bytes of seven bits."""
    return F.concat(*[B.pack(F.shiftright(n, s).bitwiseAND(127), 1) for s in (21, 14, 7, 0)])


def frame(name: str, payload: Column) -> Column:
    return F.concat(B.raw(name.encode()), _safe(F.octet_length(payload)), B.raw(b"\0\0"), payload)


def id3v2_tag(frames: list[Column]) -> Column:
    body = F.concat(*frames)
    return F.concat(B.raw(b"ID3\x04\0\0"), _safe(F.octet_length(body)), body)


def text_frame(name: str, text: Column) -> Column:
    return frame(name, F.concat(B.raw(b"\x03"), F.encode(text, "UTF-8")))


def comment_block(pairs: list[tuple[str, Column]]) -> Column:
    sized = [F.encode(F.concat(F.lit(k + "="), v), "UTF-8") for k, v in pairs]
    return F.concat(B.pack_le(F.lit(3), 4), B.raw(b"ven"), B.pack_le(F.lit(len(pairs)), 4), *[F.concat(B.pack_le(F.octet_length(x), 4), x) for x in sized])


def flac_file(rate: Column, samples: Column, pairs: list[tuple[str, Column]]) -> Column:
    info = F.concat(B.raw(b"\x10\0\x10\0" + b"\0" * 6), B.pack(F.shiftleft(rate, 44) + F.lit(1 << 41 | 15 << 36) + samples, 8), B.raw(b"\1" * 16))
    vc = comment_block(pairs)
    return F.concat(B.raw(b"fLaC\0\0\0\x22"), info, B.raw(b"\x84"), B.pack(F.octet_length(vc), 3), vc)


def wav_file(rate: Column, data_bytes: int, title: Column) -> Column:
    t = F.encode(title, "UTF-8")
    n = F.octet_length(t)
    t = F.when(n % 2 == 1, F.concat(t, B.raw(b"\0"))).otherwise(t)
    info = F.concat(B.raw(b"INFOINAM"), B.pack_le(n, 4), t)
    body = F.concat(B.raw(b"WAVEfmt \x10\0\0\0\1\0\2\0"), B.pack_le(rate, 4), B.pack_le(rate * 4, 4), B.raw(b"\4\0\x10\0"), B.raw(b"LIST"), B.pack_le(F.octet_length(info), 4), info, B.raw(b"data"), B.pack_le(F.lit(data_bytes), 4), B.raw(b"\0" * data_bytes))
    return F.concat(B.raw(b"RIFF"), B.pack_le(F.octet_length(body), 4), body)


def id3v2_text_roundtrip(spark, d):
    """Customers as ID3v2.4 tags, decoded, mapped and merged to normalized tags."""
    c = table(spark, d, "customer")
    tag = id3v2_tag([text_frame("TIT2", _c("c_name")), text_frame("TPE1", F.concat("c_mktsegment", F.lit("\0x"))), text_frame("TRCK", F.concat((_c("c_nationkey") + 1).cast("string"), F.lit("/30"))), text_frame("TDRC", F.lit("2001-05-06"))])
    files = c.select(_c("c_custkey").alias("file_id"), F.lit("id3v2").alias("loader"), tag.alias("content"))
    mapped = R.map_tags(R.tag_values(A.tag_events(A.decode_files(files))))
    got = R.normalized(mapped, ["title", "artist", "year", "track"], ["genre"])
    return got.select("file_id", "title", "artist", "year", "track")


def vorbis_comments(spark, d):
    p = table(spark, d, "part")
    content = flac_file(F.lit(44100).cast("long"), _c("p_partkey") * 44100, [("title", _c("p_name")), ("ARTIST", _c("p_brand")), ("ALBUM", F.concat(F.lit("a=b "), _c("p_type")))])
    files = p.select(_c("p_partkey").alias("file_id"), F.lit("flac").alias("loader"), content.alias("content"))
    return A.tag_events(A.decode_files(files)).select("file_id", "format_id", "tag_id", F.col("v_str").alias("value"))


def flac_format_record(spark, d):
    p = table(spark, d, "part")
    content = flac_file(F.lit(8000).cast("long") + _c("p_size") * 100, _c("p_partkey") * 8000, [("TITLE", _c("p_name"))])
    files = p.select(_c("p_partkey").alias("file_id"), F.lit("flac").alias("loader"), content.alias("content"))
    r = A.format_record(A.decode_files(files))
    return r.select("file_id", "container", "codec", "tool", "sampleRate", "numberOfChannels", "bitsPerSample", "numberOfSamples", F.round("duration", 6).alias("duration"), "lossless")


def wav_decode(spark, d):
    s = table(spark, d, "supplier")
    files = s.select(_c("s_suppkey").alias("file_id"), F.lit("wav").alias("loader"), wav_file(F.lit(8000) + _c("s_suppkey"), 400, _c("s_name")).alias("content"))
    got = A.decode_files(files)
    r = A.format_record(got).select("file_id", "codec", "sampleRate", "numberOfSamples", F.round("duration", 6).alias("duration"))
    t = A.tag_events(got).where("tag_id = 'INAM'").select("file_id", F.col("v_str").alias("title"))
    return r.join(t, "file_id")


def options_prune(spark, d):
    """A cover is left out of the rows when covers are skipped."""
    s = table(spark, d, "supplier")
    pic = frame("APIC", F.concat(B.raw(b"\0image/png\0\3\0\x89PNG"), F.encode(_c("s_name"), "UTF-8")))
    files = s.select(_c("s_suppkey").alias("file_id"), F.lit("id3v2").alias("loader"), id3v2_tag([text_frame("TIT2", _c("s_name")), pic]).alias("content"))
    each = [A.decode_files(files, o).groupBy("kind").agg(F.count("*").alias("n")).withColumn("skip", F.lit(o.skip_covers)) for o in (Options(), Options(skip_covers=True))]
    return each[0].unionByName(each[1])


def error_rows(spark, d):
    """Damaged files: the error class of each, by how they were damaged."""
    p = table(spark, d, "part")
    good = flac_file(F.lit(44100).cast("long"), F.lit(44100).cast("long"), [("TITLE", _c("p_name"))])
    how = _c("p_partkey") % 4
    content = F.when(how == 0, good).when(how == 1, F.substring(good, 1, 20)).when(how == 2, F.encode(_c("p_name"), "UTF-8"))
    files = p.select(_c("p_partkey").alias("file_id"), F.when(how == 3, F.lit(None).cast("string")).otherwise("flac").alias("loader"), content.alias("content"))
    return A.quality(A.decode_files(files)).where("kind = 'error'").groupBy("name", "file_type").agg(F.count("*").alias("n"))


def sniffed_loader(spark, d):
    p = table(spark, d, "part")
    heads = [b"fLaC", b"OggS", b"RIFF\0\0\0\0WAVE", b"FORM\0\0\0\0AIFF", b"\0\0\0\x20ftypM4A ", b"ID3\4", b"\xff\xfb\x90\0", b"MAC ", b"xxxx"]
    b = F.element_at(F.array(*[B.raw(h) for h in heads]), (_c("p_partkey") % 9 + 1).cast("int"))
    return p.groupBy(sniff(b).alias("loader")).agg(F.count("*").alias("n"))


def stream_assembly(spark, d):
    """Lines of an order as chunks of one ID3v2 stream; put together and decoded."""
    o = table(spark, d, "orders")
    tag = id3v2_tag([text_frame("TIT2", F.concat(F.lit("order "), _c("o_orderkey").cast("string")))])
    cut = F.inline(F.array(*[F.struct(F.lit(i).alias("chunk_no"), F.substring(tag, 1 + 9 * i, 9 if i < 3 else 1000).alias("data")) for i in (2, 0, 3, 1)]))
    files = A.join_chunks(o.select(_c("o_orderkey").alias("stream_id"), cut)).select(_c("stream_id").alias("file_id"), F.lit("id3v2").alias("loader"), "content")
    return A.tag_events(A.decode_files(files)).select("file_id", "tag_id", F.col("v_str").alias("value"))


def decoded(kind: str):
    """Query of one kind of container: a file for each supplier, decoded with all options."""
    title = samples.KINDS[kind][2]

    def query(spark, d):
        files = samples.files(table(spark, d, "supplier"), "s_suppkey", "s_name", kind)
        got = A.decode_files(files, "all")
        field = lambda name, col: F.max_by(F.col(col), F.when((_c("kind") == "format") & (_c("tag_id") == name), _c("seq"))).alias(name)
        chapter = F.from_json("v_json", "start long, end long")
        spans = F.collect_list(F.when(_c("kind") == "chapter", F.struct(chapter["start"].alias("start"), F.coalesce(chapter["end"], F.lit(-1)).alias("end"), _c("v_str").alias("t"))))
        text = F.array_join(F.transform(F.array_sort(spans), lambda c: F.concat_ws(" ", c["t"], c["start"].cast("string"), c["end"].cast("string"))), ", ")
        found = F.max(F.when((_c("kind") == "tag") & (_c("tag_id") == title), _c("v_str")))
        others = F.array_join(F.array_sort(F.collect_list(F.when((_c("kind") == "tag") & (_c("tag_id") != title), F.concat_ws("=", "tag_id", F.coalesce("v_str", _c("v_int").cast("string")))))), ", ")
        per = got.groupBy("file_id").agg(found.alias("title"), others.alias("others"), *[field(n, "v_str") for n in ("container", "codec")], *[field(n, "v_int") for n in ("sampleRate", "numberOfChannels", "numberOfSamples")], field("duration", "v_dbl"), text.alias("chapters"), F.count_if(_c("kind").isin("error", "warning")).alias("faults"))
        return per.withColumn("duration", F.round("duration", 6))

    query.__name__ = f"decode_{kind}"
    return query


_LIMITS = ranges.Limits(small=1024, large=4096, head=1024, tail=1024, chunk=256)


def _long_wav(spark, d):
    """A WAVE file of each supplier whose title stands behind 2,000 bytes of audio data and more."""
    s = table(spark, d, "supplier")
    t = F.encode(F.rpad("s_name", 30, " "), "UTF-8")
    n = (2000 + 2 * (_c("s_suppkey") % 1000)).cast("int")
    data = F.unhex(F.repeat(F.lit("00"), n))
    info = F.concat(B.raw(b"INFOINAM"), B.pack_le(F.lit(30), 4), t)
    body = F.concat(B.raw(b"WAVEfmt \x10\0\0\0\1\0\1\0"), B.pack_le(F.lit(1000), 4), B.pack_le(F.lit(2000), 4), B.raw(b"\2\0\x10\0data"), B.pack_le(n, 4), data, B.raw(b"LIST"), B.pack_le(F.octet_length(info), 4), info)
    content = F.concat(B.raw(b"RIFF"), B.pack_le(F.octet_length(body), 4), body)
    return s.select(_c("s_suppkey").alias("file_id"), F.lit("wav").alias("loader"), content.alias("content"))


def range_read_modes(spark, d):
    """Every strategy of reading gives the same fields, also those behind the audio data."""
    files, out = _long_wav(spark, d), None
    for strategy in ranges.STRATEGIES:
        rows = ranges.read_contents(files, "all", strategy, _LIMITS)
        one = rows.groupBy("file_id").agg(F.max(F.when(_c("tag_id") == "INAM", F.trim("v_str"))).alias("title"), F.round(F.max(F.when(_c("tag_id") == "duration", _c("v_dbl"))), 6).alias("duration"), F.max("size").alias("size"), F.count_if(_c("kind") == "error").alias("errors"))
        one = one.withColumn("asked", F.lit(strategy))
        out = one if out is None else out.unionByName(one)
    return out


def fetch_actual(spark, d):
    """Bytes and chunks that each strategy really fetches, and why it was chosen."""
    files, out = _long_wav(spark, d), None
    for strategy in ("auto", "fullDownload", "headerOnly"):
        rows = ranges.read_contents(files, "all", strategy, _LIMITS).where("kind = 'fetch'")
        one = rows.select("file_id", F.lit(strategy).alias("asked"), "strategy", "reason", "bytes_fetched", "chunks", "retries")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (id3v2_text_roundtrip, vorbis_comments, flac_format_record, wav_decode, options_prune, error_rows, sniffed_loader, stream_assembly, range_read_modes, fetch_actual, *[decoded(k) for k in samples.KINDS])}


def _decoded_sql(container: str | None, codec: str | None, rate: int | None, channels: int | None, n: str | None, seconds: str | None, chapters: str = "''", others: str = "''") -> str:
    text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"
    number = lambda v: f"CAST({'NULL' if v is None else v} AS BIGINT)"
    return f"""SELECT s_suppkey AS file_id, s_name AS title, {others} AS others, {text(container)} AS container, {text(codec)} AS codec, {number(rate)} AS sampleRate, {number(channels)} AS numberOfChannels, {number(n)} AS numberOfSamples,
        round(CAST({seconds or 'NULL'} AS DOUBLE), 6) AS duration, {chapters} AS chapters, CAST(0 AS BIGINT) AS faults FROM supplier"""


_K = "(s_suppkey + 1)"
_TWO = "'First 0 ' || {0} || ', Second ' || {0} || ' ' || {1}"
_DECODED = {
    "mpeg": _decoded_sql("MPEG", "MPEG 1 Layer 3", 44100, 2, f"({_K} % 20 + 5) * 1152", f"({_K} % 20 + 5) * 1152 / 44100.0"),
    "ogg_vorbis": _decoded_sql("Ogg", "Vorbis I", 44100, 2, f"44100 * {_K}", _K),
    "ogg_opus": _decoded_sql("Ogg", "Opus", 48000, 2, f"48000 * {_K}", _K),
    "ogg_speex": _decoded_sql("Ogg", "Speex 1.2", 16000, 1, f"16000 * {_K}", _K),
    "flac_cues": _decoded_sql("FLAC", "FLAC", 44100, 2, f"44100 * ({_K} + 2)", f"{_K} + 2", f"'Track 01 0 ' || 1000 * {_K} || ', Track 02 ' || 1000 * {_K} || ' ' || 1000 * ({_K} + 2)"),
    "wav_cues": _decoded_sql("WAVE", "PCM", 1000, 2, "1000", "1", f"'Intro 0 ' || 10 * {_K} || ', Cue 2 ' || 10 * {_K} || ' -1'"),
    "aiff": _decoded_sql("AIFF", "PCM", 8000, 1, f"8000 * {_K}", _K),
    "monkeys_audio": _decoded_sql("Monkey''s Audio", "Monkey''s Audio", 44100, 2, f"({_K} - 1) * 73728 + 100", f"(({_K} - 1) * 73728 + 100) / 44100.0"),
    "wavpack": _decoded_sql("WavPack", "PCM", 44100, 2, f"44100 * {_K}", _K),
    "musepack7": _decoded_sql("Musepack, SV7", "1.15", 44100, 2, f"1152 * ({_K} % 7) + 500", f"(1152 * ({_K} % 7) + 500) / 44100.0"),
    "musepack8": _decoded_sql("Musepack, SV8", "Musepack SV8", 48000, 2, f"48000 * {_K}", _K),
    "dsf": _decoded_sql("DSF", "DSD", 5644800, 2, f"5644800 * {_K}", _K),
    "dsdiff": _decoded_sql("DSDIFF/DSD", "DSD", 2822400, 2, f"(1000 + 2 * {_K}) * 4", f"(1000 + 2 * {_K}) * 4 / 2822400.0"),
    "asf": _decoded_sql("ASF/audio", None, None, None, None, _K),
    "matroska": _decoded_sql("EBML/webm", "OPUS", 48000, 2, None, _K, _TWO.format(f"500 * {_K}", f"1000 * {_K}")),
    "mp4": _decoded_sql("M4A/isom/mp42", "MPEG-4/AAC", 44100, 2, f"44100 * {_K}", _K, _TWO.format(f"990 * {_K}", f"1000 * {_K}"), f"'trkn=' || {_K} % 100 || '/100'"),
    "id3_22": _decoded_sql(None, None, None, None, None, None, others=f"'TRK=' || {_K} || '/' || ({_K} + 1)"),
    "id3_23": _decoded_sql(None, None, None, None, None, None, others=f"'COMM=note ' || {_K} || ', TXXX:mood=calm ' || {_K}"),
    "id3_chapters": _decoded_sql(None, None, None, None, None, None, _TWO.format(f"1000 * {_K}", f"2000 * {_K}")),
}
# size of the WAVE file: 44 bytes, the data, and a LIST of 50 bytes
_WAV_SIZE = "(94 + 2000 + 2 * (s_suppkey % 1000))"

ORACLE = {
    "id3v2_text_roundtrip": "SELECT c_custkey AS file_id, c_name AS title, c_mktsegment AS artist, '2001' AS \"year\", (c_nationkey + 1) || '/30' AS track FROM customer",
    "vorbis_comments": "SELECT p_partkey AS file_id, 'vorbis' AS format_id, t.k AS tag_id, CASE t.k WHEN 'TITLE' THEN p_name WHEN 'ARTIST' THEN p_brand ELSE 'a=b ' || p_type END AS value FROM part, (VALUES ('TITLE'), ('ARTIST'), ('ALBUM')) AS t(k)",
    "flac_format_record": "SELECT p_partkey AS file_id, 'FLAC' AS container, 'FLAC' AS codec, 'ven' AS tool, CAST(8000 + p_size * 100 AS BIGINT) AS sampleRate, CAST(2 AS BIGINT) AS numberOfChannels, CAST(16 AS BIGINT) AS bitsPerSample, CASE WHEN p_partkey > 0 THEN p_partkey * 8000 END AS numberOfSamples, CASE WHEN p_partkey > 0 THEN round(p_partkey * 8000 / CAST(8000 + p_size * 100 AS DOUBLE), 6) END AS duration, TRUE AS lossless FROM part",
    "wav_decode": "SELECT s_suppkey AS file_id, 'PCM' AS codec, 8000 + s_suppkey AS sampleRate, CAST(100 AS BIGINT) AS numberOfSamples, round(100 / CAST(8000 + s_suppkey AS DOUBLE), 6) AS duration, s_name AS title FROM supplier",
    "options_prune": "SELECT 'tag' AS kind, count(*) AS n, FALSE AS skip FROM supplier UNION ALL SELECT 'picture', count(*), FALSE FROM supplier UNION ALL SELECT 'tag', count(*), TRUE FROM supplier",
    "error_rows": "SELECT CASE p_partkey % 4 WHEN 3 THEN 'CouldNotDetermineFileTypeError' ELSE 'UnexpectedFileContentError' END AS name, CASE WHEN p_partkey % 4 <> 3 THEN 'FLAC' END AS file_type, count(*) AS n FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1, 2",
    "sniffed_loader": "SELECT ['flac', 'ogg', 'wav', 'aiff', 'mp4', 'mpeg', 'mpeg', 'apev2', NULL][p_partkey % 9 + 1] AS loader, count(*) AS n FROM part GROUP BY 1",
    "stream_assembly": "SELECT o_orderkey AS file_id, 'TIT2' AS tag_id, 'order ' || o_orderkey AS value FROM orders",
    "range_read_modes": f"""SELECT s_suppkey AS file_id, s_name AS title, round((1000 + s_suppkey % 1000) / 1000.0, 6) AS duration, CAST({_WAV_SIZE} AS BIGINT) AS size, CAST(0 AS BIGINT) AS errors, m.asked
        FROM supplier, (VALUES ('auto'), ('fullDownload'), ('headerOnly'), ('probe'), ('randomAccess')) AS m(asked)""",
    # a header read takes the first 1024 bytes and the chunks of 256 bytes that hold the LIST behind the data and what is asked for near the end
    "fetch_actual": f"""WITH f AS (SELECT s_suppkey AS file_id, {_WAV_SIZE} AS n, 44 + 2000 + 2 * (s_suppkey % 1000) AS pos FROM supplier),
        c AS (SELECT *, (n + 255) // 256 AS all_chunks, (n + 255) // 256 - greatest(4, pos // 256) AS late FROM f)
        SELECT file_id, m.asked, CASE WHEN m.asked = 'fullDownload' THEN 'fullDownload' ELSE 'headerOnly' END AS strategy, CASE WHEN m.asked = 'auto' THEN 'header format' ELSE 'asked for' END AS reason,
            CAST(CASE WHEN m.asked = 'fullDownload' THEN n ELSE 1024 + n - greatest(4, pos // 256) * 256 END AS BIGINT) AS bytes_fetched,
            CAST(CASE WHEN m.asked = 'fullDownload' THEN all_chunks ELSE 4 + late END AS INTEGER) AS chunks, 0 AS retries
        FROM c, (VALUES ('auto'), ('fullDownload'), ('headerOnly')) AS m(asked)""",
    **{f"decode_{k}": sql for k, sql in _DECODED.items()},
}
