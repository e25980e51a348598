"""Small containers made of table rows, for the queries that run the decoders."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _seven(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def id3(frames: list[tuple[str, bytes]], major: int = 4) -> bytes:
    body = b""
    for name, p in frames:
        size = len(p).to_bytes(3, "big") if major == 2 else (_seven(len(p)) if major == 4 else struct.pack(">I", len(p))) + b"\0\0"
        body += name.encode() + size + p
    return b"ID3" + bytes([major, 0, 0]) + _seven(len(body)) + body


def _chap(ident: str, start: int, end: int, title: bytes) -> bytes:
    inner = b"TIT2" + _seven(len(title) + 1) + b"\0\0\x03" + title
    return ident.encode() + b"\0" + struct.pack(">IIII", start, end, 0xFFFFFFFF, 0xFFFFFFFF) + inner


def id3_chapters(k: int, title: bytes) -> bytes:
    toc = b"toc\0\x03\x02" + b"c1\0c2\0"
    return id3([("TIT2", b"\x03" + title), ("CTOC", toc), ("CHAP", _chap("c2", 1000 * k, 2000 * k, b"Second")), ("CHAP", _chap("c1", 0, 1000 * k, b"First"))])


def mpeg(k: int, title: bytes) -> bytes:
    return id3([("TIT2", b"\x03" + title)]) + (b"\xff\xfb\x90\0" + bytes(413)) * (k % 20 + 5)


def _comments(pairs: list[bytes]) -> bytes:
    return struct.pack("<I", 3) + b"ven" + struct.pack("<I", len(pairs)) + b"".join(struct.pack("<I", len(p)) + p for p in pairs)


def _page(flags: int, granule: int, packet: bytes) -> bytes:
    lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
    return b"OggS\0" + bytes([flags]) + struct.pack("<qII", granule, 1, 0) + b"\0" * 4 + bytes([len(lacing)]) + lacing + packet


def ogg_vorbis(k: int, title: bytes) -> bytes:
    head = b"\x01vorbis" + struct.pack("<IBIiiiB", 0, 2, 44100, 0, 128000, 0, 0xB8) + b"\x01"
    return _page(2, 0, head) + _page(0, 0, b"\x03vorbis" + _comments([b"TITLE=" + title])) + _page(4, 44100 * k, b"x" * 50)


def ogg_opus(k: int, title: bytes) -> bytes:
    return _page(2, 0, b"OpusHead\x01" + struct.pack("<BHIhB", 2, 312, 0, 0, 0)) + _page(0, 0, b"OpusTags" + _comments([b"TITLE=" + title])) + _page(4, 312 + 48000 * k, b"x" * 50)


def ogg_speex(k: int, title: bytes) -> bytes:
    head = b"Speex   " + b"1.2".ljust(20, b"\0") + struct.pack("<IIIIIiiIIIIII", 1, 80, 16000, 1, 4, 1, -1, 320, 0, 1, 0, 0, 0)
    return _page(2, 0, head) + _page(0, 0, _comments([b"TITLE=" + title])) + _page(4, 16000 * k, b"x" * 50)


def flac_cues(k: int, title: bytes) -> bytes:
    info = struct.pack(">HH", 4096, 4096) + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | 44100 * (k + 2)).to_bytes(8, "big") + b"\1" * 16
    track = lambda at, n: struct.pack(">QB", at, n) + bytes(12) + bytes(14) + b"\1" + struct.pack(">QB", 0, 1) + bytes(3)
    cue = bytes(128) + bytes(8) + b"\x80" + bytes(258) + b"\x03" + track(0, 1) + track(44100 * k, 2) + struct.pack(">QB", 44100 * (k + 2), 170) + bytes(12) + bytes(14) + b"\0"
    vc = _comments([b"TITLE=" + title])
    return b"fLaC\0\0\0\x22" + info + b"\x04" + len(vc).to_bytes(3, "big") + vc + b"\x85" + len(cue).to_bytes(3, "big") + cue


def _chunk(name: bytes, p: bytes, order: str = "<") -> bytes:
    return name + struct.pack(order + "I", len(p)) + p + b"\0" * (len(p) % 2)


def wav_cues(k: int, title: bytes) -> bytes:
    fmt = struct.pack("<HHIIHH", 1, 2, 1000, 4000, 4, 16)
    cue = struct.pack("<I", 2) + b"".join(struct.pack("<II4sIII", n, 0, b"data", 0, 0, at) for n, at in ((1, 0), (2, 10 * k)))
    body = b"WAVE" + _chunk(b"fmt ", fmt) + _chunk(b"LIST", b"INFO" + _chunk(b"INAM", title)) + _chunk(b"cue ", cue) + _chunk(b"LIST", b"adtl" + _chunk(b"labl", struct.pack("<I", 1) + b"Intro\0")) + _chunk(b"data", bytes(4000))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def aiff(k: int, title: bytes) -> bytes:
    comm = struct.pack(">HIHHH", 1, 8000 * k, 16, 16383 + 12, 8000 << 3) + bytes(6)
    body = b"AIFF" + _chunk(b"COMM", comm, ">") + _chunk(b"NAME", title, ">") + _chunk(b"SSND", bytes(1000), ">")
    return b"FORM" + struct.pack(">I", len(body)) + body


def _ape_tag(title: bytes) -> bytes:
    body = struct.pack("<II", len(title), 0) + b"Title\0" + title
    return body + b"APETAGEX" + struct.pack("<IIII", 2000, len(body) + 32, 1, 0) + bytes(8)


def monkeys_audio(k: int, title: bytes) -> bytes:
    desc = (b"MAC " + struct.pack("<HHII", 3990, 0, 52, 24)).ljust(52, b"\0")
    return desc + struct.pack("<HHIIIHHI", 2000, 0, 73728, 100, k, 16, 2, 44100) + bytes(500) + _ape_tag(title)


def wavpack(k: int, title: bytes) -> bytes:
    block = struct.pack("<HBBIIII", 0x410, 0, 0, 44100 * k, 0, 44100 * k, 1 | 9 << 23)
    return b"wvpk" + struct.pack("<I", len(block)) + block + _ape_tag(title)


def musepack7(k: int, title: bytes) -> bytes:
    lengths = [30 + i for i in range(k % 7 + 1)]
    bits = f"{115:08b}" + "".join(f"{n:020b}" + "1" * n for n in lengths) + f"{500:011b}"
    bits += "0" * (-len(bits) % 32)
    words = b"".join(struct.pack("<I", int(bits[i : i + 32], 2)) for i in range(0, len(bits), 32))
    return b"MP+\x07" + struct.pack("<II", len(lengths), 0) + bytes(8) + struct.pack("<I", 500 << 20) + words + _ape_tag(title)


def musepack8(k: int, title: bytes) -> bytes:
    n, groups = 48000 * k, []
    while n or not groups:
        groups.append(n & 127)
        n >>= 7
    size = bytes(g | 128 for g in groups[:0:-1]) + bytes([groups[0]])
    packet = lambda key, v: key + bytes([len(v) + 3]) + v
    return b"MPCK" + packet(b"SH", bytes(4) + b"\x08" + size + b"\0" + b"\x20\x10") + packet(b"AP", bytes(100)) + packet(b"SE", b"") + _ape_tag(title)


def dsf(k: int, title: bytes) -> bytes:
    fmt = b"fmt " + struct.pack("<Q", 52) + struct.pack("<IIIIIIQI", 1, 0, 2, 2, 5644800, 1, 5644800 * k, 4096) + bytes(4)
    tag = id3([("TIT2", b"\x03" + title)])
    return b"DSD " + struct.pack("<QQQ", 28, 80 + len(tag), 80) + fmt + tag


def dsdiff(k: int, title: bytes) -> bytes:
    c = lambda n, p: n + struct.pack(">Q", len(p)) + p + b"\0" * (len(p) % 2)
    prop = b"SND " + c(b"FS  ", struct.pack(">I", 2822400)) + c(b"CHNL", struct.pack(">H", 2) + b"SLFTSRGT")
    body = b"DSD " + c(b"PROP", prop) + c(b"DSD ", bytes(1000 + 2 * k)) + c(b"ID3 ", id3([("TIT2", b"\x03" + title)]))
    return b"FRM8" + struct.pack(">Q", len(body)) + body


def _guid(text: str) -> bytes:
    a, b, c, d, e = text.split("-")
    return bytes.fromhex(a)[::-1] + bytes.fromhex(b)[::-1] + bytes.fromhex(c)[::-1] + bytes.fromhex(d) + bytes.fromhex(e)


def asf(k: int, title: bytes) -> bytes:
    part = lambda g, p: _guid(g) + struct.pack("<Q", len(p) + 24) + p
    w = title.decode().encode("utf-16-le") + b"\0\0"
    file = bytes(40) + struct.pack("<QQQ", 10_000_000 * (k + 1), 0, 1000) + bytes(12) + struct.pack("<I", 192639)
    stream = _guid("F8699E40-5B4D-11CF-A8FD-00805F5C442B") + bytes(38)
    content = struct.pack("<HHHHH", len(w), 0, 0, 0, 0) + w
    body = part("8CABDCA1-A947-11CF-8EE4-00C00C205365", file) + part("B7DC0791-A9B7-11CF-8EE6-00C00C205365", stream) + part("75B22633-668E-11CF-A6D9-00AA0062CE6C", content)
    return _guid("75B22630-668E-11CF-A6D9-00AA0062CE6C") + struct.pack("<QIBB", len(body) + 30, 3, 1, 2) + body


def _ebml(ident: str, p: bytes) -> bytes:
    return bytes.fromhex(ident) + (0x10000000 | len(p)).to_bytes(4, "big") + p


def matroska(k: int, title: bytes) -> bytes:
    u = lambda i, v: _ebml(i, v.to_bytes(4, "big"))
    info = _ebml("1549A966", u("2AD7B1", 1000000) + _ebml("4489", struct.pack(">d", 1000.0 * k)))
    track = _ebml("1654AE6B", _ebml("AE", u("D7", 1) + u("83", 2) + _ebml("86", b"A_OPUS") + _ebml("E1", _ebml("B5", struct.pack(">d", 48000.0)) + u("9F", 2))))
    tags = _ebml("1254C367", _ebml("7373", _ebml("63C0", u("68CA", 30)) + _ebml("67C8", _ebml("45A3", b"TITLE") + _ebml("4487", title))))
    chapter = lambda at, name: _ebml("B6", u("73C4", at) + _ebml("91", (at * 1_000_000).to_bytes(8, "big")) + _ebml("80", _ebml("85", name)))
    chapters = _ebml("1043A770", _ebml("45B9", chapter(0, b"First") + chapter(500 * k, b"Second")))
    cluster = _ebml("1F43B675", bytes(500))
    table = lambda at: _ebml("114D9B74", _ebml("4DBB", _ebml("53AB", bytes.fromhex("1254C367")) + _ebml("53AC", at.to_bytes(4, "big"))))
    front = table(0) + info + track + chapters + cluster
    return _ebml("1A45DFA3", _ebml("4282", b"webm")) + _ebml("18538067", table(len(front)) + info + track + chapters + cluster + tags)


def _atom(name: bytes, p: bytes) -> bytes:
    return struct.pack(">I", len(p) + 8) + name + p


def mp4(k: int, title: bytes) -> bytes:
    full = bytes(4)
    mvhd = full + struct.pack(">IIII", 0, 0, 1000, 1000 * k) + bytes(80)
    mdhd = full + struct.pack(">IIII", 0, 0, 44100, 44100 * k) + bytes(4)
    entry = struct.pack(">I4s", 36, b"mp4a") + bytes(16) + struct.pack(">HHHHI", 2, 16, 0, 0, 44100 << 16)
    stbl = _atom(b"stbl", _atom(b"stsd", full + struct.pack(">I", 1) + entry))
    trak = _atom(b"tkhd", full + struct.pack(">III", 0, 0, 1) + bytes(60)) + _atom(b"mdia", _atom(b"mdhd", mdhd) + _atom(b"hdlr", full + bytes(4) + b"soun" + bytes(13)) + _atom(b"minf", stbl))
    data = lambda kind, v: _atom(b"data", struct.pack(">II", kind, 0) + v)
    ilst = _atom(b"\xa9nam", data(1, title)) + _atom(b"trkn", data(0, struct.pack(">HHHH", 0, k % 100, 100, 0)))
    chpl = b"\x01" + bytes(7) + b"\x02" + struct.pack(">Q", 0) + b"\x05First" + struct.pack(">Q", 9_900_000 * k) + b"\x06Second"
    udta = _atom(b"udta", _atom(b"meta", full + _atom(b"ilst", ilst)) + _atom(b"chpl", chpl))
    return _atom(b"ftyp", b"M4A " + bytes(4) + b"isommp42") + _atom(b"moov", _atom(b"mvhd", mvhd) + _atom(b"trak", trak) + udta) + _atom(b"mdat", bytes(1000))


def id3_22(k: int, title: bytes) -> bytes:
    return id3([("TT2", b"\x03" + title), ("TRK", b"\0" + str(k).encode() + b"/" + str(k + 1).encode())], 2)


def id3_23(k: int, title: bytes) -> bytes:
    return id3([("TIT2", b"\x01\xff\xfe" + title.decode().encode("utf-16-le")), ("TXXX", b"\0mood\0calm " + str(k).encode()), ("COMM", b"\0eng\0note " + str(k).encode())], 3)


#: Query name -> (loader, builder, native id of the title).
KINDS: dict[str, tuple[str, Callable[[int, bytes], bytes], str]] = {
    "mpeg": ("mpeg", mpeg, "TIT2"), "ogg_vorbis": ("ogg", ogg_vorbis, "TITLE"), "ogg_opus": ("ogg", ogg_opus, "TITLE"), "ogg_speex": ("ogg", ogg_speex, "TITLE"), "flac_cues": ("flac", flac_cues, "TITLE"), "wav_cues": ("wav", wav_cues, "INAM"), "aiff": ("aiff", aiff, "NAME"),
    "monkeys_audio": ("apev2", monkeys_audio, "Title"), "wavpack": ("wavpack", wavpack, "Title"), "musepack7": ("musepack", musepack7, "Title"), "musepack8": ("musepack", musepack8, "Title"), "dsf": ("dsf", dsf, "TIT2"), "dsdiff": ("dsdiff", dsdiff, "TIT2"), "asf": ("asf", asf, "Title"),
    "matroska": ("matroska", matroska, "track:TITLE"), "mp4": ("mp4", mp4, "\xa9nam"), "id3_22": ("id3v2", id3_22, "TT2"), "id3_23": ("id3v2", id3_23, "TIT2"), "id3_chapters": ("id3v2", id3_chapters, "TIT2"),
}


def files(rows: DataFrame, key: str, title: str, kind: str) -> DataFrame:
    """(file_id, loader, content): a file of a kind for each row; its numbers come from the key plus 1, since some formats know no length 0."""
    loader, build, _ = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [build(k + 1, t.encode()) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([loader] * len(content), pa.string()), pa.array(content, pa.binary())], ["file_id", "loader", "content"])

    return rows.select(F.col(key).cast("long").alias("file_id"), title).mapInArrow(run, "file_id long, loader string, content binary")
