"""Decoders of fixed layouts as Column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom import catalog
from tagloom.functions import binary as B

# kbit/s by bitrate index (rows 1..14) and version-layer 11 12 13 21 22 23.
_KBIT = """
32 32 32 32 8 8
64 48 40 48 16 16
96 56 48 56 24 24
128 64 56 64 32 32
160 80 64 80 40 40
192 96 80 96 48 48
224 112 96 112 56 56
256 128 112 128 64 64
288 160 128 144 80 80
320 192 160 160 96 96
352 224 192 176 112 112
384 256 224 192 128 128
416 320 256 224 144 144
448 384 320 256 160 160
"""
KBIT = [[int(x) for x in row.split()] for row in _KBIT.strip().split("\n")]
RATES = {1.0: [44100, 48000, 32000], 2.0: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}
AAC_PROFILES = ["AAC Main", "AAC LC", "AAC SSR", "AAC LTP"]
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
AAC_CHANNELS = [None, 1, 2, 3, 4, 5, 6, 8]
WAVE_CODECS = {1: "PCM", 2: "ADPCM", 3: "IEEE_FLOAT", 9: "DRM", 80: "MPEG", 146: "DOLBY_AC3_SPDIF", 255: "RAW_AAC1", 5632: "MPEG_ADTS_AAC", 5634: "MPEG_LOAS", 576: "RAW_SPORT", 577: "ESST_AC3", 8192: "DVM", 8193: "DTS2"}


def lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def id3v1(content: Column) -> dict[str, Column]:
    """Fields of the last 128 bytes; all null without the TAG mark. The track of version 1.1 needs a zero byte before it."""
    block = B.part(content, -128, 128)
    ok = (F.octet_length(content) >= 128) & (B.latin1(B.part(block, 0, 3)) == "TAG")
    zero, track, genre = B.u8(block, 125), B.u8(block, 126), B.u8(block, 127)
    v11 = (zero == 0) & (track != 0)
    names = F.array(*[F.lit(g) for g in catalog.genres()])
    cols = {
        "title": B.field(block, 3, 30),
        "artist": B.field(block, 33, 30),
        "album": B.field(block, 63, 30),
        "year": B.field(block, 93, 4),
        "comment": F.when(v11, B.field(block, 97, 28)).otherwise(B.field(block, 97, 30)),
        "track": F.when(v11, track.cast("int")),
        "genre": F.when(genre > 0, F.try_element_at(names, (genre + 1).cast("int"))),
    }
    return {k: F.when(ok, v) for k, v in cols.items()}


def flac_streaminfo(b: Column) -> dict[str, Column]:
    packed = B.be(b, 10, 4)
    low = B.be(b, 14, 4)
    return {
        "min_block": B.be(b, 0, 2),
        "max_block": B.be(b, 2, 2),
        "min_frame": B.be(b, 4, 3),
        "max_frame": B.be(b, 7, 3),
        "sample_rate": B.bits(packed, 12, 20),
        "channels": B.bits(packed, 9, 3) + 1,
        "bits": B.bits(packed, 4, 5) + 1,
        "samples": F.shiftleft(B.bits(packed, 0, 4), 32) + low,
        "md5": F.lower(F.hex(B.part(b, 18, 16))),
    }


def wave_fmt(b: Column) -> dict[str, Column]:
    tag = B.le(b, 0, 2)
    return {"format_tag": tag, "codec": lookup(WAVE_CODECS, tag.cast("int")), "channels": B.le(b, 2, 2), "sample_rate": B.le(b, 4, 4), "avg_bytes": B.le(b, 8, 4), "block_align": B.le(b, 12, 2), "bits": B.le(b, 14, 2)}


def wave_bitrate(fmt: dict[str, Column]) -> Column:
    return F.when(fmt["format_tag"] == 2, F.lit(352000).cast("long")).otherwise(fmt["block_align"] * fmt["sample_rate"] * 8)


def mpeg_header(b: Column) -> dict[str, Column]:
    """Version, layer, rates and frame length of a 4-byte MPEG audio header; null fields where it is none."""
    b1, b2, b3 = B.u8(b, 1), B.u8(b, 2), B.u8(b, 3)
    v = B.bits(b1, 3, 2)
    layer = F.lit(4) - B.bits(b1, 1, 2)
    version = F.when(v == 0, 2.5).when(v == 2, 2.0).when(v == 3, 1.0)
    ri, si = B.bits(b2, 4, 4), B.bits(b2, 2, 2)
    ok = (B.u8(b, 0) == 255) & (B.bits(b1, 5, 3) == 7) & version.isNotNull() & (layer < 4) & (ri > 0) & (ri < 15) & (si < 3)
    column = F.when(version == 1.0, layer).otherwise(layer + 3)
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in KBIT])
    rates = F.array(*[F.array(*[F.lit(x) for x in RATES[k]]) for k in (1.0, 2.0, 2.5)])
    bitrate = F.try_element_at(F.try_element_at(table, ri.cast("int")), column.cast("int")) * 1000
    rate = F.try_element_at(F.try_element_at(rates, F.when(version == 1.0, 1).when(version == 2.0, 2).otherwise(3)), (si + 1).cast("int"))
    spf = F.when(layer == 1, 384).when((layer == 3) & (version != 1.0), 576).otherwise(1152)
    pad = B.bits(b2, 1, 1) * F.when(layer == 1, 4).otherwise(1)
    length = F.floor(spf / F.lit(8.0) * bitrate / rate + pad)
    name = F.concat(F.lit("MPEG "), F.when(version == 2.5, "2.5").otherwise(version.cast("int").cast("string")), F.lit(" Layer "), layer.cast("string"))
    cols = {"version": version, "layer": layer, "codec": name, "bitrate": bitrate, "sample_rate": rate, "samples_per_frame": spf, "frame_length": length, "mono": B.bits(b3, 6, 2) == 3, "crc": B.bits(b1, 0, 1) == 0}
    return {k: F.when(ok & (length > 4), c) for k, c in cols.items()}


def adts_header(b: Column) -> dict[str, Column]:
    b2, b3 = B.u8(b, 2), B.u8(b, 3)
    rates = F.array(*[F.lit(r) for r in AAC_RATES])
    channels = F.array(*[F.lit(c).cast("int") for c in AAC_CHANNELS])
    ok = (B.u8(b, 0) == 255) & (B.bits(B.u8(b, 1), 4, 4) == 15) & (B.bits(B.u8(b, 1), 1, 2) == 0)
    cols = {
        "profile": F.element_at(F.array(*[F.lit(p) for p in AAC_PROFILES]), (B.bits(b2, 6, 2) + 1).cast("int")),
        "sample_rate": F.try_element_at(rates, (B.bits(b2, 2, 4) + 1).cast("int")),
        "channels": F.try_element_at(channels, (F.shiftleft(B.bits(b2, 0, 1), 2) + B.bits(b3, 6, 2) + 1).cast("int")),
        "frame_length": F.shiftleft(B.bits(b3, 0, 2), 11) + F.shiftleft(B.u8(b, 4), 3) + B.bits(B.u8(b, 5), 5, 3),
    }
    return {k: F.when(ok, c) for k, c in cols.items()}


def replay_gain(word: Column) -> dict[str, Column]:
    """Kind (1 track, 2 album), origin and gain in dB of a 16-bit word."""
    tenths = B.bits(word, 0, 9)
    return {"kind": B.bits(word, 13, 3), "origin": B.bits(word, 10, 3), "gain": F.when(B.bits(word, 9, 1) == 1, -tenths).otherwise(tenths) / 10.0}


def replay_peak(word: Column) -> Column:
    return word / float(1 << 23)


def opus_head(b: Column) -> dict[str, Column]:
    rate = B.le(b, 12, 4)
    ok = B.latin1(B.part(b, 0, 8)) == "OpusHead"
    return {k: F.when(ok, c) for k, c in {"version": B.u8(b, 8), "channels": B.u8(b, 9), "pre_skip": B.le(b, 10, 2), "sample_rate": F.when(rate == 0, 48000).otherwise(rate)}.items()}


def opus_duration(granule: Column, pre_skip: Column) -> Column:
    return (granule - pre_skip) / 48000.0


def vorbis_head(b: Column) -> dict[str, Column]:
    return {"channels": B.u8(b, 11), "sample_rate": B.le(b, 12, 4), "bitrate": B.le32_signed(b, 20)}


def speex_head(b: Column) -> dict[str, Column]:
    return {"codec": F.concat(F.lit("Speex "), B.until_nul(B.latin1(B.part(b, 8, 20)))), "sample_rate": B.le(b, 36, 4), "channels": B.le(b, 48, 4), "bitrate": B.le32_signed(b, 52)}


def ogg_page(b: Column) -> dict[str, Column]:
    ok = B.latin1(B.part(b, 0, 4)) == "OggS"
    kind = B.u8(b, 5)
    return {k: F.when(ok, c) for k, c in {"continued": B.flag(kind, 0), "first": B.flag(kind, 1), "last": B.flag(kind, 2), "granule": B.narrow(B.le64(b, 6)), "serial": B.le(b, 14, 4), "page_no": B.le(b, 18, 4), "segments": B.u8(b, 26)}.items()}


def ape_header(b: Column) -> dict[str, Column]:
    """Header of Monkey's Audio (24 bytes): samples = (frames - 1) * blocks + last."""
    blocks, last, frames, rate = B.le(b, 4, 4), B.le(b, 8, 4), B.le(b, 12, 4), B.le(b, 20, 4)
    samples = F.when(frames > 0, (frames - 1) * blocks + last)
    return {"bits": B.le(b, 16, 2), "channels": B.le(b, 18, 2), "sample_rate": rate, "samples": samples, "duration": F.when(rate > 0, samples / rate)}


def ape_item_flags(flags: Column) -> dict[str, Column]:
    return {"has_header": B.flag(flags, 31), "has_footer": ~B.flag(flags, 30), "is_header": B.flag(flags, 29), "kind": B.bits(flags, 1, 2), "read_only": B.flag(flags, 0)}


def dsf_fmt(b: Column) -> dict[str, Column]:
    channels, rate, bits = B.le(b, 12, 4), B.le(b, 16, 4), B.le(b, 20, 4)
    samples = B.narrow(B.le64(b, 24))
    return {"channels": channels, "sample_rate": rate, "bits": bits, "samples": samples, "bitrate": bits * rate * channels, "duration": samples / rate}


def aiff_rate(b: Column, at: int) -> Column:
    """80-bit float of a whole sample rate, by its exponent and the upper 16 bits of the mantissa."""
    shift = B.be(b, at, 2) - 16398
    mantissa = B.be(b, at + 2, 2)
    return F.when(shift < 0, F.call_function("shiftright", mantissa, F.abs(shift).cast("int"))).otherwise(F.call_function("shiftleft", mantissa, shift.cast("int")))


def guid(b: Column) -> Column:
    """Text of a mixed-endian 16-byte GUID, upper case."""
    h = [F.hex(B.flip(B.part(b, 0, 4), 4)), F.hex(B.flip(B.part(b, 4, 2), 2)), F.hex(B.flip(B.part(b, 6, 2), 2)), F.hex(B.part(b, 8, 2)), F.hex(B.part(b, 10, 6))]
    return F.concat_ws("-", *h)


def mac_time(seconds: Column) -> Column:
    """Timestamp of seconds since 1904, kept within the years 1 to 9999."""
    return F.timestamp_seconds(F.least(F.greatest(seconds - 2082844800, F.lit(-62135596800)), F.lit(253402300799)))


def mp4_brands(payload: Column) -> Column:
    """Ordered distinct brands of an ftyp atom, non-word characters removed, joined by '/'."""
    n = F.floor(F.octet_length(payload) / 4).cast("int")
    words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.regexp_replace(B.latin1(F.substring(payload, i * 4 + 1, F.lit(4))), r"\W", ""))
    return F.array_join(F.array_distinct(F.filter(words, lambda w: w != "")), "/")


def picture_mime(b: Column) -> Column:
    head = F.hex(B.part(b, 0, 4))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head == "89504E47", "image/png").when(head.startswith("474946"), "image/gif")


def signed_be(b: Column, n: int) -> Column:
    """Signed big-endian integer of n < 8 bytes, null beyond 32 bits."""
    v = B.unsigned(b, n)
    s = F.when(v >= 1 << (8 * n - 1), v - (1 << 8 * n)).otherwise(v)
    return F.when((s >= -(1 << 31)) & (s < 1 << 31), s)
