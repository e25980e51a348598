"""Queries of fixed-layout decoders: bytes are built from table rows and decoded again; SQL states the result over the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom import catalog
from tagloom.functions import binary as B
from tagloom.sources import fixed_layout as L
from tagloom.session import table

_c = F.col


def id3v1_roundtrip(spark, d):
    p = table(spark, d, "part")
    block = F.concat(
        B.raw(b"\xff\xfb\x90\x00" * 4), B.raw(b"TAG"), B.pad(_c("p_name"), 30), B.pad(_c("p_brand"), 30), B.pad(_c("p_type"), 30), B.pad(F.lit("1999"), 4), B.pad(F.lit("note"), 28), B.raw(b"\x00"),
        B.pack(_c("p_size"), 1), B.pack(_c("p_partkey") % 192, 1),
    )
    got = p.select("p_partkey", block.alias("content"))
    return got.select("p_partkey", *[v.alias(k) for k, v in L.id3v1(_c("content")).items()])


def flac_streaminfo(spark, d):
    o = table(spark, d, "orders")
    rate, ch, bits, samples = F.lit(8000) + _c("o_orderkey") % 90000, _c("o_custkey") % 8, _c("o_orderkey") % 32, _c("o_totalprice").cast("long") * 100000
    packed = F.shiftleft(rate, 44) + F.shiftleft(ch, 41) + F.shiftleft(bits, 36) + samples
    b = F.concat(B.pack(F.lit(4096), 2), B.pack(F.lit(4608), 2), B.pack(_c("o_orderkey"), 3), B.pack(_c("o_custkey"), 3), F.unhex(F.lpad(F.hex(packed), 16, "0")), F.unhex(F.md5(_c("o_orderkey").cast("string"))))
    got = o.select("o_orderkey", b.alias("b"))
    return got.select("o_orderkey", *[v.alias(k) for k, v in L.flac_streaminfo(_c("b")).items()])


def wav_fmt(spark, d):
    o = table(spark, d, "orders")
    tag = F.element_at(F.array(*[F.lit(x) for x in (1, 2, 3, 85, 255, 8193)]), (_c("o_orderkey") % 6 + 1).cast("int"))
    b = F.concat(B.pack_le(tag, 2), B.pack_le(_c("o_custkey") % 6 + 1, 2), B.pack_le(F.lit(8000) + _c("o_orderkey") % 40000, 4), B.pack_le(_c("o_orderkey"), 4), B.pack_le(_c("o_custkey") % 9 + 1, 2), B.pack_le(F.lit(16), 2))
    got = o.select("o_orderkey", b.alias("b"))
    f = L.wave_fmt(_c("b"))
    return got.select("o_orderkey", *[f[k].alias(k) for k in ("format_tag", "codec", "channels", "sample_rate", "block_align", "bits")], L.wave_bitrate(f).alias("bitrate"))


def mpeg_header_decode(spark, d):
    p = table(spark, d, "part")
    k = _c("p_partkey")
    v, ly = F.element_at(F.array(F.lit(0), F.lit(2), F.lit(3)), (k % 3 + 1).cast("int")), k % 4
    b1 = F.lit(224) + v * 8 + ly * 2 + 1
    b2 = (F.floor(k / 3) % 16) * 16 + (F.floor(k / 7) % 4) * 4 + (k % 2) * 2
    b = F.concat(B.raw(b"\xff"), B.pack(b1, 1), B.pack(b2, 1), B.pack((k % 4) * 64, 1))
    got = p.select("p_partkey", b.alias("b"))
    h = L.mpeg_header(_c("b"))
    return got.select("p_partkey", *[h[x].alias(x) for x in ("codec", "bitrate", "sample_rate", "samples_per_frame", "frame_length", "mono")])


def adts_bitrate(spark, d):
    """Average bit rate of the ADTS frames of each order: 8 * mean length * rate / 1024, rounded."""
    li = table(spark, d, "lineitem")
    n = _c("l_quantity").cast("long") * 20 + 7
    r = _c("l_orderkey") % 13
    b = F.concat(B.raw(b"\xff\xf1"), B.pack(F.lit(64) + r * 4 + F.floor(F.lit(2) / 4), 1), B.pack(F.lit(128) + F.floor(n / 2048), 1), B.pack(F.floor(n / 8) % 256, 1), B.pack((n % 8) * 32, 1), B.raw(b"\xfc"))
    got = li.select("l_orderkey", b.alias("b"))
    h = L.adts_header(_c("b"))
    frames = got.select("l_orderkey", h["profile"].alias("profile"), h["sample_rate"].alias("sample_rate"), h["channels"].alias("channels"), h["frame_length"].alias("n"))
    return frames.groupBy("l_orderkey", "profile", "sample_rate", "channels").agg(F.round(F.sum("n") * 8 * _c("sample_rate") / (F.count("*") * 1024)).cast("long").alias("bitrate"))


def replaygain_words(spark, d):
    p = table(spark, d, "part")
    word = F.shiftleft(_c("p_partkey") % 3, 13) + F.shiftleft(_c("p_partkey") % 4, 10) + F.shiftleft(_c("p_partkey") % 2, 9) + _c("p_partkey") * 7 % 512
    got = p.select("p_partkey", B.be(B.pack(word, 2), 0, 2).alias("w"))
    return got.select("p_partkey", *[v.alias(k) for k, v in L.replay_gain(_c("w")).items()], F.round(L.replay_peak(_c("w") * 128), 6).alias("peak"))


def opus_duration(spark, d):
    o = table(spark, d, "orders")
    b = F.concat(B.raw(b"OpusHead\x01"), B.pack(_c("o_custkey") % 2 + 1, 1), B.pack_le(_c("o_orderkey") % 4000, 2), B.pack_le(F.when(_c("o_orderkey") % 3 == 0, 0).otherwise(44100), 4), B.raw(b"\x00\x00\x00"))
    got = o.select("o_orderkey", "o_totalprice", b.alias("b"))
    h = L.opus_head(_c("b"))
    return got.select("o_orderkey", h["channels"].alias("channels"), h["sample_rate"].alias("sample_rate"), F.round(L.opus_duration(_c("o_totalprice").cast("long") * 100, h["pre_skip"]), 6).alias("duration"))


def ogg_granule_max(spark, d):
    """Pages of each order as a stream: the largest granule, and whether the stream was closed."""
    li = table(spark, d, "lineitem")
    page = F.concat(B.raw(b"OggS\x00"), B.pack(F.when(_c("l_returnflag") == "R", 4).otherwise(0), 1), B.pack_le(_c("l_partkey") * 100, 8), B.pack_le(_c("l_orderkey"), 4), B.pack_le(_c("l_linenumber"), 4), B.raw(b"\x00\x00\x00\x00\x01"))
    got = li.select(page.alias("b"))
    h = L.ogg_page(_c("b"))
    return got.select(h["serial"].alias("serial"), h["granule"].alias("g"), h["last"].alias("l")).groupBy("serial").agg(F.max("g").alias("granule"), F.max("l").alias("closed"), F.count("*").alias("pages"))


def ape_header_duration(spark, d):
    p = table(spark, d, "part")
    b = F.concat(B.pack_le(F.lit(2000), 2), B.pack_le(F.lit(0), 2), B.pack_le(F.lit(73728), 4), B.pack_le(_c("p_partkey"), 4), B.pack_le(_c("p_size"), 4), B.pack_le(F.lit(16), 2), B.pack_le(F.lit(2), 2), B.pack_le(F.lit(44100), 4))
    got = p.select("p_partkey", b.alias("b"))
    h = L.ape_header(_c("b"))
    return got.select("p_partkey", h["samples"].alias("samples"), h["channels"].alias("channels"), F.round(h["duration"], 6).alias("duration"))


def dsf_format(spark, d):
    p = table(spark, d, "part")
    rate = F.when(_c("p_partkey") % 2 == 0, 2822400).otherwise(5644800)
    b = F.concat(B.pack_le(F.lit(1), 4), B.pack_le(F.lit(0), 4), B.pack_le(F.lit(2), 4), B.pack_le(_c("p_partkey") % 6 + 1, 4), B.pack_le(rate, 4), B.pack_le(F.lit(1), 4), B.pack_le(_c("p_partkey") * 100000, 8), B.pack_le(F.lit(4096), 4))
    got = p.select("p_partkey", b.alias("b"))
    h = L.dsf_fmt(_c("b"))
    return got.select("p_partkey", h["channels"].alias("channels"), h["sample_rate"].alias("sample_rate"), h["bitrate"].alias("bitrate"), F.round(h["duration"], 6).alias("duration"))


def aiff_comm_rate(spark, d):
    s = table(spark, d, "supplier")
    rate = F.element_at(F.array(*[F.lit(x) for x in (8000, 22050, 32000, 44100, 48000)]), (_c("s_suppkey") % 5 + 1).cast("int"))
    # the exponent that puts the rate's first bit at the top of 16 bits
    lead = F.floor(F.log2(rate.cast("double"))).cast("int")
    b = F.concat(B.pack(_c("s_suppkey") % 2 + 1, 2), B.pack(_c("s_suppkey") * 1000, 4), B.pack(F.lit(16), 2), B.pack(lead + 16383, 2), B.pack(F.call_function("shiftleft", rate.cast("long"), F.lit(15) - lead), 2), B.raw(b"\x00" * 6))
    got = s.select("s_suppkey", b.alias("b"))
    return got.select("s_suppkey", B.be(_c("b"), 2, 4).alias("frames"), L.aiff_rate(_c("b"), 8).alias("sample_rate"))


def asf_guid_text(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", L.guid(F.unhex(F.md5(_c("p_name")))).alias("guid"))


def mp4_mac_epoch(spark, d):
    o = table(spark, d, "orders")
    sec = F.unix_seconds(_c("o_orderdate").cast("timestamp")) + 2082844800
    return o.select("o_orderkey", F.date_format(L.mac_time(B.be(B.pack(sec, 4), 0, 4)), "yyyy-MM-dd HH:mm:ss").alias("created"))


def mp4_brands(spark, d):
    p = table(spark, d, "part")
    payload = F.concat(B.raw(b"M4A "), B.raw(b"\x00\x00\x02\x00"), F.when(_c("p_partkey") % 2 == 0, B.raw(b"isom")).otherwise(B.raw(b"mp42")), B.raw(b"M4A "), F.when(_c("p_partkey") % 3 == 0, B.raw(b"qt  ")).otherwise(B.raw(b"isom")))
    return p.select("p_partkey", L.mp4_brands(payload).alias("container"))


def mp4_signed_int(spark, d):
    s = table(spark, d, "supplier")
    v = _c("s_suppkey") * 91 - 4000
    return s.select("s_suppkey", L.signed_be(B.pack(F.pmod(v, F.lit(65536)), 2), 2).alias("v"))


def synchsafe_size(spark, d):
    p = table(spark, d, "part")
    n = _c("p_partkey") * 1237
    b = F.concat(*[B.pack(F.shiftright(n, 7 * k).bitwiseAND(127), 1) for k in (3, 2, 1, 0)])
    return p.select("p_partkey", B.synchsafe(b, 0).alias("size"))


def id3v2_encodings(spark, d):
    """Names of nations written as latin-1, UTF-16 with mark, UTF-16BE with mark and UTF-8, read back."""
    n = table(spark, d, "nation")
    name, k = F.concat(_c("n_name"), F.lit(" é")), _c("n_nationkey") % 4
    b = F.when(k == 0, F.encode(name, "ISO-8859-1")).when(k == 1, F.concat(B.raw(b"\xff\xfe"), F.encode(name, "UTF-16LE"))).when(k == 2, F.concat(B.raw(b"\xfe\xff"), F.encode(name, "UTF-16BE"))).otherwise(F.encode(name, "UTF-8"))
    got = n.select("n_nationkey", b.alias("b"))
    j = _c("n_nationkey") % 4
    return got.select("n_nationkey", F.when(j == 0, B.latin1(_c("b"))).when(j == 3, B.utf8(_c("b"))).otherwise(B.utf16(_c("b"))).alias("name"))


def id3v2_split_values(spark, d):
    """Text frames before version 2.4 split at '/', trimmed."""
    p = table(spark, d, "part")
    text = F.concat(_c("p_brand"), F.lit(" / "), _c("p_type"))
    return p.select("p_partkey", F.posexplode(F.transform(F.split(text, "/"), lambda x: F.trim(x))).alias("pos", "value"))


def picture_mime(spark, d):
    p = table(spark, d, "part")
    k = _c("p_partkey") % 4
    b = F.when(k == 0, B.raw(b"\xff\xd8\xff\xe0")).when(k == 1, B.raw(b"\x89PNG")).when(k == 2, B.raw(b"GIF8")).otherwise(B.raw(b"BM00"))
    return p.groupBy(L.picture_mime(b).alias("mime")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (id3v1_roundtrip, flac_streaminfo, wav_fmt, mpeg_header_decode, adts_bitrate, replaygain_words, opus_duration, ogg_granule_max, ape_header_duration, dsf_format, aiff_comm_rate, asf_guid_text, mp4_mac_epoch, mp4_brands, mp4_signed_int, synchsafe_size, id3v2_encodings, id3v2_split_values, picture_mime)}

_GENRES = catalog.sql_values(enumerate(catalog.genres()), "g(i, name)")
_KBIT = catalog.sql_values([(i + 1, [11, 12, 13, 21, 22, 23][j], x) for i, row in enumerate(L.KBIT) for j, x in enumerate(row)], "kb(ri, code, kbit)")
_RATE = catalog.sql_values([(v, i, r) for v, k in ((3, 1.0), (2, 2.0), (0, 2.5)) for i, r in enumerate(L.RATES[k])], "sr(vv, si, rate)")
_AAC = catalog.sql_values(enumerate(L.AAC_RATES), "ar(i, rate)")
_WAVE = catalog.sql_values(L.WAVE_CODECS.items(), "wc(tag, name)")

ORACLE = {
    "id3v1_roundtrip": f"SELECT p_partkey, nullif(trim(substr(p_name, 1, 30)), '') AS title, nullif(trim(substr(p_brand, 1, 30)), '') AS artist, nullif(trim(substr(p_type, 1, 30)), '') AS album, '1999' AS \"year\", 'note' AS comment, CASE WHEN p_size <> 0 THEN CAST(p_size AS INT) END AS track, CASE WHEN p_partkey % 192 > 0 THEN g.name END AS genre FROM part JOIN {_GENRES} ON g.i = p_partkey % 192",
    "flac_streaminfo": "SELECT o_orderkey, CAST(4096 AS BIGINT) AS min_block, CAST(4608 AS BIGINT) AS max_block, o_orderkey AS min_frame, o_custkey AS max_frame, 8000 + o_orderkey % 90000 AS sample_rate, o_custkey % 8 + 1 AS channels, o_orderkey % 32 + 1 AS bits, CAST(floor(o_totalprice) AS BIGINT) * 100000 AS samples, md5(CAST(o_orderkey AS VARCHAR)) AS md5 FROM orders",
    "wav_fmt": f"WITH x AS (SELECT *, [1, 2, 3, 85, 255, 8193][o_orderkey % 6 + 1] AS format_tag, 8000 + o_orderkey % 40000 AS sample_rate, o_custkey % 9 + 1 AS block_align FROM orders) SELECT o_orderkey, CAST(format_tag AS BIGINT) AS format_tag, wc.name AS codec, o_custkey % 6 + 1 AS channels, sample_rate, block_align, CAST(16 AS BIGINT) AS bits, CASE WHEN format_tag = 2 THEN 352000 ELSE block_align * sample_rate * 8 END AS bitrate FROM x LEFT JOIN {_WAVE} ON wc.tag = x.format_tag",
    "mpeg_header_decode": f"""WITH x AS (SELECT p_partkey, [0, 2, 3][p_partkey % 3 + 1] AS v, 4 - p_partkey % 4 AS layer, (p_partkey // 3) % 16 AS ri, (p_partkey // 7) % 4 AS si, p_partkey % 2 AS pad, p_partkey % 4 = 3 AS mono FROM part),
        y AS (SELECT x.*, kb.kbit * 1000 AS bitrate, sr.rate, CASE WHEN layer = 1 THEN 384 WHEN layer = 3 AND v <> 3 THEN 576 ELSE 1152 END AS spf
              FROM x JOIN {_KBIT} ON kb.ri = x.ri AND kb.code = CASE WHEN v = 3 THEN 10 ELSE 20 END + layer JOIN {_RATE} ON sr.vv = x.v AND sr.si = x.si),
        z AS (SELECT *, CAST(floor(spf / 8.0 * bitrate / rate + pad * CASE WHEN layer = 1 THEN 4 ELSE 1 END) AS BIGINT) AS n FROM y)
        SELECT x.p_partkey, 'MPEG ' || CASE z.v WHEN 3 THEN '1' WHEN 2 THEN '2' WHEN 0 THEN '2.5' END || ' Layer ' || z.layer AS codec, z.bitrate, z.rate AS sample_rate, z.spf AS samples_per_frame, z.n AS frame_length, z.mono
        FROM x LEFT JOIN z ON z.p_partkey = x.p_partkey AND z.n > 4""",
    "adts_bitrate": f"SELECT l_orderkey, 'AAC LC' AS profile, ar.rate AS sample_rate, 2 AS channels, CAST(round(sum(CAST(l_quantity AS BIGINT) * 20 + 7) * 8 * ar.rate / (count(*) * 1024)) AS BIGINT) AS bitrate FROM lineitem JOIN {_AAC} ON ar.i = l_orderkey % 13 GROUP BY l_orderkey, ar.rate",
    "replaygain_words": "SELECT p_partkey, p_partkey % 3 AS kind, p_partkey % 4 AS origin, CASE WHEN p_partkey % 2 = 1 THEN -1 ELSE 1 END * (p_partkey * 7 % 512) / 10.0 AS gain, round(((p_partkey % 3) * 8192 + (p_partkey % 4) * 1024 + (p_partkey % 2) * 512 + p_partkey * 7 % 512) * 128 / 8388608.0, 6) AS peak FROM part",
    "opus_duration": "SELECT o_orderkey, o_custkey % 2 + 1 AS channels, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 48000 ELSE 44100 END AS BIGINT) AS sample_rate, round((CAST(floor(o_totalprice) AS BIGINT) * 100 - o_orderkey % 4000) / 48000.0, 6) AS duration FROM orders",
    "ogg_granule_max": "SELECT l_orderkey AS serial, max(l_partkey * 100) AS granule, max(l_returnflag = 'R') AS closed, count(*) AS pages FROM lineitem GROUP BY l_orderkey",
    "ape_header_duration": "SELECT p_partkey, (p_size - 1) * 73728 + p_partkey AS samples, CAST(2 AS BIGINT) AS channels, round(((p_size - 1) * 73728 + p_partkey) / 44100.0, 6) AS duration FROM part",
    "dsf_format": "SELECT p_partkey, p_partkey % 6 + 1 AS channels, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2822400 ELSE 5644800 END AS BIGINT) AS sample_rate, CASE WHEN p_partkey % 2 = 0 THEN 2822400 ELSE 5644800 END * (p_partkey % 6 + 1) AS bitrate, round(p_partkey * 100000 / CAST(CASE WHEN p_partkey % 2 = 0 THEN 2822400 ELSE 5644800 END AS DOUBLE), 6) AS duration FROM part",
    "aiff_comm_rate": "SELECT s_suppkey, s_suppkey * 1000 AS frames, [8000, 22050, 32000, 44100, 48000][s_suppkey % 5 + 1]::BIGINT AS sample_rate FROM supplier",
    "asf_guid_text": "WITH h AS (SELECT p_partkey, upper(md5(p_name)) AS h FROM part) SELECT p_partkey, h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14] || '-' || h[17:20] || '-' || h[21:32] AS guid FROM h",
    "mp4_mac_epoch": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created FROM orders",
    "mp4_brands": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'M4A/isom/qt' ELSE 'M4A/isom' END ELSE CASE WHEN p_partkey % 3 = 0 THEN 'M4A/mp42/qt' ELSE 'M4A/mp42/isom' END END AS container FROM part",
    "mp4_signed_int": "SELECT s_suppkey, s_suppkey * 91 - 4000 AS v FROM supplier",
    "synchsafe_size": "SELECT p_partkey, p_partkey * 1237 AS size FROM part",
    "id3v2_encodings": "SELECT n_nationkey, n_name || ' é' AS name FROM nation",
    "id3v2_split_values": "SELECT p_partkey, 0 AS pos, trim(p_brand) AS value FROM part UNION ALL SELECT p_partkey, 1, trim(p_type) FROM part",
    "picture_mime": "SELECT CASE p_partkey % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' END AS mime, count(*) AS n FROM part GROUP BY 1",
}
