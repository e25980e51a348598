"""ID3v1 and ID3v2 (2.2, 2.3, 2.4)."""

from __future__ import annotations

import re

from tagloom import catalog
from tagloom.sources.decode.events import Events, clean, picture_mime, picture_type, with_ends

_FRAME_ID = {2: re.compile(rb"[A-Z][A-Z0-9]{2}"), 3: re.compile(rb"[A-Z][A-Z0-9]{3}"), 4: re.compile(rb"[A-Z][A-Z0-9]{3}")}
_CODECS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def id3v1(b: bytes, out: Events) -> bool:
    t = b[-128:]
    if len(t) < 128 or t[:3] != b"TAG":
        return False
    text = lambda lo, hi: clean(t[lo:hi].decode("latin-1")) or None
    numbered = t[125] == 0 and t[126] != 0
    names = catalog.genres()
    for name, value in (
        ("title", text(3, 33)),
        ("artist", text(33, 63)),
        ("album", text(63, 93)),
        ("year", text(93, 97)),
        ("comment", text(97, 125 if numbered else 127)),
        ("track", int(t[126]) if numbered else None),
        ("genre", names[t[127]] if 0 < t[127] < len(names) else None),
    ):
        out.tag("ID3v1", name, value)
    return True


def synchsafe(b: bytes) -> int:
    n = 0
    for x in b:
        n = n << 7 | x & 127
    return n


def decode_text(kind: int, raw: bytes) -> str:
    if kind in (1, 2):
        if raw[:2] == b"\xfe\xff":
            return raw[2:].decode("utf-16-be", "replace")
        if raw[:2] == b"\xff\xfe":
            return raw[2:].decode("utf-16-le", "replace")
        return raw.decode("utf-16-be" if kind == 2 else "utf-16-le", "replace")
    return raw.decode(_CODECS.get(kind, "utf-8"), "replace")


def _cut(kind: int, raw: bytes) -> tuple[bytes, bytes]:
    """Bytes before and after the terminator of the encoding."""
    if kind not in (1, 2):
        head, _, rest = raw.partition(b"\x00")
        return head, rest
    for i in range(0, len(raw) - 1, 2):
        if raw[i : i + 2] == b"\x00\x00":
            return raw[:i], raw[i + 2 :]
    return raw, b""


_UNSPLIT = {"TRK", "TRCK", "TPOS", "TPA", "TIT1", "TIT2", "TIT3", "TT1", "TT2", "TT3"}


class Tag:
    """One ID3v2 tag: its frames become events, CHAP and CTOC become chapters."""

    def __init__(self, out: Events, major: int) -> None:
        self.out, self.major = out, major
        self.format_id = f"ID3v2.{major}"
        self.chapters: dict[str, dict] = {}
        self.toc: list[str] | None = None

    def frames(self, b: bytes):
        """(id, payload) of each frame; stops at padding, at an invalid id and at an overrun."""
        head = 6 if self.major == 2 else 10
        width = 3 if self.major == 2 else 4
        at = 0
        while at + head <= len(b):
            ident = b[at : at + width]
            if ident[0] == 0:
                return
            if not _FRAME_ID[self.major].fullmatch(ident):
                self.out.warn(f"invalid {self.format_id} frame id")
                return  # the caller goes on behind the tag
            raw_size = b[at + width : at + width + (3 if self.major == 2 else 4)]
            size = synchsafe(raw_size) if self.major == 4 else int.from_bytes(raw_size, "big")
            flags = b[at + 9] if self.major > 2 else 0
            payload = b[at + head : at + head + size]
            if len(payload) < size:
                self.out.warn(f"{self.format_id} frame {ident.decode()} overruns its tag")
                return
            if self.major == 4:
                if flags & 1:
                    payload = payload[4:]
                if flags & 2:
                    payload = payload.replace(b"\xff\x00", b"\xff")
            yield ident.decode(), payload
            at += head + size

    def values(self, ident: str, text: str) -> list[str]:
        if ident in _UNSPLIT:
            return [text.rstrip("\x00").strip()]
        if self.major == 4 or "\x00" in text.rstrip("\x00"):
            if self.major < 4:
                self.out.warn(f"{self.format_id} {ident} holds NUL separated values")
            parts = text.rstrip("\x00").split("\x00")
        else:
            parts = text.rstrip("\x00").split("/") if self.out.options.split_slash else [text.rstrip("\x00")]
        return [p.strip() for p in parts]

    def read(self, b: bytes) -> None:
        for ident, p in self.frames(b):
            self.frame(ident, p)
        if self.chapters:
            known = [self.chapters[c] for c in self.toc if c in self.chapters] if self.toc is not None else sorted(self.chapters.values(), key=lambda c: c["start"])
            self.out.chapters(known if self.toc is not None else with_ends(known, None))

    def frame(self, ident: str, p: bytes) -> None:
        if not p:
            return
        if ident in ("TXXX", "TXX"):
            head, rest = _cut(p[0], p[1:])
            values = self.values("TXXX", decode_text(p[0], rest))
            self.out.tag(self.format_id, f"TXXX:{decode_text(p[0], head)}", values[0] if values else None)
        elif ident[0] == "T":
            values = self.values(ident, decode_text(p[0], p[1:]))
            self.out.tag(self.format_id, ident, values if len(values) > 1 else values[0])
        elif ident in ("COMM", "COM"):
            head, rest = _cut(p[0], p[4:])
            self.out.tag(self.format_id, ident, decode_text(p[0], rest).rstrip("\x00"), {"language": p[1:4].decode("latin-1"), "descriptor": decode_text(p[0], head)})
        elif ident in ("APIC", "PIC"):
            self.picture(ident, p)
        elif ident == "UFID":
            owner, _, data = p.partition(b"\x00")
            self.out.tag(self.format_id, ident, data, {"owner": owner.decode("latin-1")})
        elif ident == "CHAP":
            self.chapter(p)
        elif ident == "CTOC":
            _, _, rest = p.partition(b"\x00")
            if len(rest) >= 2 and (rest[0] & 2 or self.toc is None):
                self.toc = [x.decode("latin-1") for x in rest[2:].split(b"\x00")[: rest[1]]]

    def picture(self, ident: str, p: bytes) -> None:
        if ident == "PIC":
            mime, rest = {b"JPG": "image/jpeg", b"PNG": "image/png"}.get(p[1:4].upper()), p[4:]
        else:
            raw, _, rest = p[1:].partition(b"\x00")
            mime = raw.decode("latin-1").lower()
            mime = {"jpg": "image/jpeg", "image/jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png"}.get(mime, mime)
        if rest:
            head, data = _cut(p[0], rest[1:])
            self.out.picture(self.format_id, ident, data, mime or picture_mime(data), picture_type(rest[0]), decode_text(p[0], head))

    def chapter(self, p: bytes) -> None:
        ident, _, rest = p.partition(b"\x00")
        if len(rest) < 16:
            return
        start, end, lo, _ = (int.from_bytes(rest[i : i + 4], "big") for i in (0, 4, 8, 12))
        c = {"id": ident.decode("latin-1"), "title": "Chapter", "start": start, "end": end, "sample_offset": None if lo == 0xFFFFFFFF else lo}
        for name, sub in self.frames(rest[16:]):
            if name in ("TIT2", "TT2") and sub:
                c["title"] = decode_text(sub[0], sub[1:]).rstrip("\x00")
            elif name == "WXXX" and sub:
                head, url = _cut(sub[0], sub[1:])
                c["url"] = url.decode("latin-1").rstrip("\x00")
                c["url_description"] = decode_text(sub[0], head)
            elif name in ("APIC", "PIC") and sub:
                self.picture(name, sub)
        self.chapters[c["id"]] = c


def id3v2(b: bytes, at: int, out: Events) -> int:
    """Reads all tags from ``at`` on; returns the offset behind the last one."""
    while b[at : at + 3] == b"ID3" and at + 10 <= len(b):
        major, flags, size = b[at + 3], b[at + 5], synchsafe(b[at + 6 : at + 10])
        body = b[at + 10 : at + 10 + size]
        if major not in (2, 3, 4):
            out.warn(f"ID3v2.{major} is not supported")
        else:
            if flags & 128 and major < 4:
                body = body.replace(b"\xff\x00", b"\xff")
            if flags & 64 and major > 2 and len(body) >= 4:
                skip = synchsafe(body[:4]) if major == 4 else int.from_bytes(body[:4], "big") + 4
                body = body[skip:]
            Tag(out, major).read(body)
        at += 10 + size + (10 if flags & 16 and major == 4 else 0)
    return at
