"""ASF: WMA and WMV headers."""

from __future__ import annotations

from tagloom.sources.decode.events import ContentError, Events, picture_type, unpack

# Objects by GUID.
_HEADER = "75B22630-668E-11CF-A6D9-00AA0062CE6C"
_FILE = "8CABDCA1-A947-11CF-8EE4-00C00C205365"
_STREAM = "B7DC0791-A9B7-11CF-8EE6-00C00C205365"
_EXTENSION = "5FBF03B5-A92E-11CF-8EE3-00C00C205365"
_CONTENT = "75B22633-668E-11CF-A6D9-00AA0062CE6C"
_EXTENDED = "D2D0A440-E307-11D2-97F0-00A0C95EA850"
_METADATA = "C5F8CBEA-5BAF-4877-8467-AA8C44FA4CCA"
_LIBRARY = "44231C94-9498-49D1-A141-1D134E457054"
_CODECS = "86D15240-311D-11D0-A3A4-00A0C90348F6"
_AUDIO, _VIDEO = "F8699E40-5B4D-11CF-A8FD-00805F5C442B", "BC19EFC0-5B4D-11CF-A8FD-00805F5C442B"


def guid(b: bytes) -> str:
    parts = b[3::-1] if len(b) >= 16 else b""
    return "-".join(x.hex().upper() for x in (parts, b[5:3:-1], b[7:5:-1], b[8:10], b[10:16]))


def text(b: bytes) -> str:
    return b.decode("utf-16-le", "replace").split("\x00", 1)[0]


def value(kind: int, v: bytes, wide_bool: bool):
    if kind == 0:
        return text(v)
    if kind == 1:
        return v
    if kind == 2:
        return int.from_bytes(v[: 4 if wide_bool else 2], "little") != 0
    return int.from_bytes(v, "little")


def objects(b: bytes, at: int, end: int):
    while at + 24 <= end:
        (size,) = unpack("<Q", b, at + 16)
        if size < 24:
            return
        yield guid(b[at : at + 16]), b[at + 24 : min(at + size, end)]
        at += size


class Header:
    def __init__(self, out: Events) -> None:
        self.out = out
        self.codecs: list[str] = []
        self.kinds: set[str] = set()

    def read(self, ident: str, p: bytes) -> None:
        out = self.out
        if ident == _FILE:
            play, _, preroll = unpack("<QQQ", p, 40)
            out.format(duration=max(0.0, play / 1e7 - preroll / 1e3))
            (rate,) = unpack("<I", p, 76)
            out.format(bitrate=float(rate))
        elif ident == _STREAM:
            media = guid(p[:16])
            self.kinds |= {"audio"} if media == _AUDIO else {"video"} if media == _VIDEO else set()
        elif ident == _EXTENSION:
            for i, q in objects(p, 22, len(p)):
                self.read(i, q)
        elif ident == _CONTENT:
            sizes = unpack("<HHHHH", p)
            at = 10
            for name, n in zip(("Title", "Author", "Copyright", "Description", "Rating"), sizes):
                if n:
                    self.tag(name, text(p[at : at + n]))
                at += n
        elif ident == _EXTENDED:
            (count,) = unpack("<H", p)
            at = 2
            for _ in range(count):
                (n,) = unpack("<H", p, at)
                name = text(p[at + 2 : at + 2 + n])
                kind, size = unpack("<HH", p, at + 2 + n)
                at += 6 + n
                self.tag(name, value(kind, p[at : at + size], True))
                at += size
        elif ident in (_METADATA, _LIBRARY):
            (count,) = unpack("<H", p)
            at = 2
            for _ in range(count):
                _, _, n, kind, size = unpack("<HHHHI", p, at)
                name = text(p[at + 12 : at + 12 + n])
                at += 12 + n
                self.tag(name, value(kind, p[at : at + size], False))
                at += size
        elif ident == _CODECS:
            (count,) = unpack("<I", p, 16)
            at = 20
            for _ in range(count):
                kind, n = unpack("<HH", p, at)
                name = text(p[at + 4 : at + 4 + 2 * n])
                at += 4 + 2 * n
                for width in (2, 1):
                    (n,) = unpack("<H", p, at)
                    at += 2 + n * width
                if kind == 2:
                    self.codecs.append(name)

    def tag(self, name: str, v) -> None:
        if name == "WM/Picture" and isinstance(v, bytes):
            (size,) = unpack("<I", v, 1)
            mime = text(v[5:])
            at = 5 + 2 * (len(mime) + 1)
            note = text(v[at:])
            at += 2 * (len(note) + 1)
            self.out.picture("asf", name, v[at : at + size], mime, picture_type(v[0]), note)
        else:
            self.out.tag("asf", name, v)


def asf(b: bytes, out: Events) -> None:
    if guid(b[:16]) != _HEADER:
        raise ContentError("ASF", "the header object is missing")
    (size,) = unpack("<Q", b, 16)
    h = Header(out)
    for ident, p in objects(b, 30, min(size, len(b))):
        try:
            h.read(ident, p)
        except ContentError as e:
            out.warn(f"object {ident}: {e}")
    kind = "audio" if "audio" in h.kinds and "video" not in h.kinds else "video" if "video" in h.kinds else None
    out.format(container=f"ASF/{kind}" if kind else "ASF", codec="/".join(h.codecs) or None, hasAudio="audio" in h.kinds, hasVideo="video" in h.kinds)
