"""Bytes of small synthetic containers."""

import struct


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def id3v2(frames: list[tuple[str, bytes]], major: int = 4) -> bytes:
    body = b""
    for name, p in frames:
        if major == 2:
            body += name.encode() + len(p).to_bytes(3, "big") + p
        else:
            body += name.encode() + (synchsafe(len(p)) if major == 4 else struct.pack(">I", len(p))) + b"\0\0" + p
    return b"ID3" + bytes([major, 0, 0]) + synchsafe(len(body)) + body


def id3v1(title: str = "T", artist: str = "A", album: str = "L", year: str = "1999", track: int = 5, genre: int = 13) -> bytes:
    f = lambda s, n: s.encode("latin-1").ljust(n, b"\0")
    return b"TAG" + f(title, 30) + f(artist, 30) + f(album, 30) + f(year, 4) + f("c", 28) + bytes([0, track, genre])


def vorbis_comment(pairs: list[str], vendor: str = "ven") -> bytes:
    v = vendor.encode()
    out = struct.pack("<I", len(v)) + v + struct.pack("<I", len(pairs))
    for p in pairs:
        out += struct.pack("<I", len(p.encode())) + p.encode()
    return out


def streaminfo(rate=44100, channels=2, bits=16, samples=132300) -> bytes:
    return struct.pack(">HH", 4096, 4096) + b"\0" * 6 + (rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | samples).to_bytes(8, "big") + b"\x01" * 16


def flac(comments: list[str]) -> bytes:
    si, vc = streaminfo(), vorbis_comment(comments)
    return b"fLaC" + b"\0" + len(si).to_bytes(3, "big") + si + b"\x84" + len(vc).to_bytes(3, "big") + vc + b"\0" * 1000


def ogg_page(serial: int, flags: int, granule: int, packets: list[bytes]) -> bytes:
    lacing, data = b"", b""
    for p in packets:
        n = len(p)
        lacing += b"\xff" * (n // 255) + bytes([n % 255])
        data += p
    return b"OggS\0" + bytes([flags]) + struct.pack("<qII", granule, serial, 0) + b"\0" * 4 + bytes([len(lacing)]) + lacing + data


def vorbis(comments: list[str]) -> bytes:
    head = b"\x01vorbis" + struct.pack("<IBIiiiB", 0, 2, 44100, 0, 128000, 0, 0xB8) + b"\x01"
    return ogg_page(1, 2, 0, [head]) + ogg_page(1, 0, 0, [b"\x03vorbis" + vorbis_comment(comments)]) + ogg_page(1, 4, 88200, [b"x" * 50])


def opus(comments: list[str]) -> bytes:
    head = b"OpusHead\x01" + struct.pack("<BHIhB", 2, 312, 0, 0, 0)
    return ogg_page(1, 2, 0, [head]) + ogg_page(1, 0, 0, [b"OpusTags" + vorbis_comment(comments)]) + ogg_page(1, 4, 48312, [b"x" * 50])


def chunk(name: bytes, p: bytes, order: str = "<") -> bytes:
    return name + struct.pack(order + "I", len(p)) + p + b"\0" * (len(p) % 2)


def wav() -> bytes:
    fmt = struct.pack("<HHIIHH", 1, 2, 1000, 4000, 4, 16)
    cue = struct.pack("<I", 2) + struct.pack("<II4sIII", 1, 0, b"data", 0, 0, 0) + struct.pack("<II4sIII", 2, 0, b"data", 0, 0, 500)
    adtl = b"adtl" + chunk(b"labl", struct.pack("<I", 1) + b"Intro\0") + chunk(b"ltxt", struct.pack("<II", 2, 250) + b"\0" * 12)
    info = b"INFO" + chunk(b"INAM", b"Song\0") + chunk(b"IART", b"Band\0")
    body = b"WAVE" + chunk(b"fmt ", fmt) + chunk(b"LIST", info) + chunk(b"cue ", cue) + chunk(b"LIST", adtl) + chunk(b"data", b"\0" * 4000)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def aiff() -> bytes:
    comm = struct.pack(">HIHHH", 1, 8000, 16, 16383 + 12, 8000 << 3) + b"\0" * 6
    body = b"AIFF" + chunk(b"COMM", comm, ">") + chunk(b"NAME", b"Song", ">") + chunk(b"SSND", b"\0" * 16008, ">")
    return b"FORM" + struct.pack(">I", len(body)) + body


def ape_tag(items: list[tuple[str, bytes, int]]) -> bytes:
    body = b"".join(struct.pack("<II", len(v), kind << 1) + k.encode() + b"\0" + v for k, v, kind in items)
    return body + b"APETAGEX" + struct.pack("<IIII", 2000, len(body) + 32, len(items), 0) + b"\0" * 8


def monkeys(items) -> bytes:
    desc = b"MAC " + struct.pack("<HHIIIIIIII", 3990, 0, 52, 24, 0, 0, 1000, 0, 0, 0) + b"\0" * 12
    head = struct.pack("<HHIIIHHI", 2000, 0, 73728, 100, 3, 16, 2, 44100)
    return desc.ljust(52, b"\0") + head + b"\0" * 500 + ape_tag(items)


def atom(name: bytes, p: bytes) -> bytes:
    return struct.pack(">I", len(p) + 8) + name + p


def mp4() -> bytes:
    full = b"\0" * 4
    mvhd = full + struct.pack(">IIII", 0, 0, 1000, 2000) + b"\0" * 80
    tkhd = full + struct.pack(">III", 0, 0, 1) + b"\0" * 60
    mdhd = full + struct.pack(">IIII", 0, 0, 44100, 88200) + b"\0" * 4
    hdlr = full + b"\0" * 4 + b"soun" + b"\0" * 13
    entry = struct.pack(">I4s", 36, b"mp4a") + b"\0" * 16 + struct.pack(">HHHHI", 2, 16, 0, 0, 44100 << 16)
    stbl = atom(b"stsd", full + struct.pack(">I", 1) + entry)
    trak = atom(b"tkhd", tkhd) + atom(b"mdia", atom(b"mdhd", mdhd) + atom(b"hdlr", hdlr) + atom(b"minf", atom(b"stbl", stbl)))
    data = lambda kind, v: atom(b"data", struct.pack(">II", kind, 0) + v)
    ilst = atom(b"\xa9nam", data(1, "Tïtle".encode())) + atom(b"trkn", data(0, struct.pack(">HHHH", 0, 1, 12, 0))) + atom(b"covr", data(13, b"\xff\xd8\xff\x01"))
    ilst += atom(b"----", atom(b"mean", full + b"com.apple.iTunes") + atom(b"name", full + b"LABEL") + data(1, b"Lbl"))
    chpl = b"\x01\0\0\0\0\0\0\0\x02" + struct.pack(">Q", 0) + b"\x05Start" + struct.pack(">Q", 19900000) + b"\x00"
    udta = atom(b"meta", full + atom(b"ilst", ilst)) + atom(b"chpl", chpl)
    moov = atom(b"mvhd", mvhd) + atom(b"trak", trak) + atom(b"udta", udta)
    return atom(b"ftyp", b"M4A \0\0\x02\0isommp42") + atom(b"moov", moov) + atom(b"mdat", b"\0" * 1000)


def ebml(ident: str, p: bytes) -> bytes:
    return bytes.fromhex(ident) + (0x10000000 | len(p)).to_bytes(4, "big") + p


def matroska() -> bytes:
    u = lambda i, v: ebml(i, v.to_bytes(4, "big"))
    info = ebml("1549A966", u("2AD7B1", 1000000) + ebml("4489", struct.pack(">d", 5000.0)) + ebml("7BA9", b"Ttl"))
    track = ebml("1654AE6B", ebml("AE", u("D7", 1) + u("83", 2) + ebml("86", b"A_OPUS") + ebml("E1", ebml("B5", struct.pack(">d", 48000.0)) + u("9F", 2))))
    tags = ebml("1254C367", ebml("7373", ebml("63C0", u("68CA", 30)) + ebml("67C8", ebml("45A3", b"ARTIST") + ebml("4487", b"Art"))))
    chap = ebml("1043A770", ebml("45B9", ebml("B6", u("73C4", 7) + ebml("91", (0).to_bytes(8, "big")) + ebml("80", ebml("85", b"Intro")))))
    return ebml("1A45DFA3", ebml("4282", b"webm")) + ebml("18538067", info + track + tags + chap)


def guid(text: str) -> bytes:
    a, b, c, d, e = text.split("-")
    return bytes.fromhex(a)[::-1] + bytes.fromhex(b)[::-1] + bytes.fromhex(c)[::-1] + bytes.fromhex(d) + bytes.fromhex(e)


def asf() -> bytes:
    obj = lambda g, p: guid(g) + struct.pack("<Q", len(p) + 24) + p
    w = lambda s: s.encode("utf-16-le") + b"\0\0"
    file = b"\0" * 40 + struct.pack("<QQQ", 30_000_000, 0, 1000) + b"\0" * 12 + struct.pack("<I", 192639)
    stream = guid("F8699E40-5B4D-11CF-A8FD-00805F5C442B") + b"\0" * 38
    content = struct.pack("<HHHHH", len(w("Ttl")), len(w("Aut")), 0, 0, 0) + w("Ttl") + w("Aut")
    name = w("WM/TrackNumber")
    ext = struct.pack("<H", 1) + struct.pack("<H", len(name)) + name + struct.pack("<HH", 3, 4) + struct.pack("<I", 9)
    body = obj("8CABDCA1-A947-11CF-8EE4-00C00C205365", file) + obj("B7DC0791-A9B7-11CF-8EE6-00C00C205365", stream) + obj("75B22633-668E-11CF-A6D9-00AA0062CE6C", content) + obj("D2D0A440-E307-11D2-97F0-00A0C95EA850", ext)
    return guid("75B22630-668E-11CF-A6D9-00AA0062CE6C") + struct.pack("<QIBB", len(body) + 30, 4, 1, 2) + body


def mpeg_frames(n: int = 10) -> bytes:
    head = bytes([0xFF, 0xFB, 0x90, 0x00])  # MPEG 1 Layer 3, 128 kbit/s, 44100 Hz, stereo
    return (head + b"\0" * 413) * n


def wavpack() -> bytes:
    flags = 1 | 9 << 23
    block = struct.pack("<HBBIIII", 0x410, 0, 0, 44100, 0, 44100, flags) + b"\0" * 4
    size = len(block) + 2 + 16
    return b"wvpk" + struct.pack("<I", size) + block + bytes([0x26, 8]) + b"\x05" * 16


def dsf() -> bytes:
    fmt = b"fmt " + struct.pack("<Q", 52) + struct.pack("<IIIIIIQI", 1, 0, 2, 2, 5644800, 1, 564480, 4096) + b"\0" * 4
    tag = id3v2([("TIT2", b"\x03Song")])
    return b"DSD " + struct.pack("<QQQ", 28, 28 + 52 + len(tag), 28 + 52) + fmt + tag


def dsdiff() -> bytes:
    c = lambda n, p: n + struct.pack(">Q", len(p)) + p + b"\0" * (len(p) % 2)
    prop = b"SND " + c(b"FS  ", struct.pack(">I", 2822400)) + c(b"CHNL", struct.pack(">H", 2) + b"SLFTSRGT")
    body = b"DSD " + c(b"PROP", prop) + c(b"DSD ", b"\0" * 1000)
    return b"FRM8" + struct.pack(">Q", len(body)) + body


def musepack8() -> bytes:
    sh = b"\0" * 4 + b"\x08" + b"\x81\xbb\x40" + b"\0" + bytes([0x00, 0x10])
    p = lambda k, v: k + bytes([len(v) + 3]) + v
    return b"MPCK" + p(b"SH", sh) + p(b"AP", b"\0" * 100) + p(b"SE", b"")
