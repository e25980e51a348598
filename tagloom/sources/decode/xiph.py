"""FLAC and Ogg (Vorbis, Opus, Speex, FLAC, Theora), with Vorbis comments and chapters."""

from __future__ import annotations

import base64
import binascii
import re
from collections import defaultdict

from tagloom.sources.decode.events import ContentError, Events, picture_type, round_half_up, unpack, with_ends
from tagloom.sources.decode.id3 import id3v2

_STAMP = re.compile(r"(\d+):(\d{2}):(\d{2})(?:\.(\d{1,3}))?")
_CHAPTER = re.compile(r"CHAPTER(\d+)(NAME)?")


def picture_block(b: bytes, out: Events, tag_id: str = "METADATA_BLOCK_PICTURE") -> None:
    kind, n = unpack(">II", b)
    mime = b[8 : 8 + n].decode("utf-8", "replace")
    (m,) = unpack(">I", b, 8 + n)
    text = b[12 + n : 12 + n + m].decode("utf-8", "replace")
    (size,) = unpack(">I", b, 28 + n + m)
    out.picture("vorbis", tag_id, b[32 + n + m : 32 + n + m + size], mime, picture_type(kind), text)


def comments(b: bytes, out: Events, at: int = 0) -> None:
    (n,) = unpack("<I", b, at)
    vendor = b[at + 4 : at + 4 + n].decode("utf-8", "replace")
    out.format(tool=vendor or None)
    at += 4 + n
    (count,) = unpack("<I", b, at)
    at += 4
    stamps: dict[int, dict] = defaultdict(dict)
    for _ in range(count):
        (size,) = unpack("<I", b, at)
        raw = b[at + 4 : at + 4 + size]
        if len(raw) < size:
            out.warn("a Vorbis comment overruns its block")
            break
        at += 4 + size
        key, _, value = raw.decode("utf-8", "replace").partition("=")
        key = key.upper()
        if key == "METADATA_BLOCK_PICTURE":
            try:
                picture_block(base64.b64decode(value, validate=True), out)
            except (binascii.Error, ValueError, ContentError):
                out.warn("a picture comment can't be decoded")
            continue
        if key == "ENCODER":
            out.format(tool=value or None)
        if m := _CHAPTER.fullmatch(key):
            stamps[int(m.group(1))]["name" if m.group(2) else "time"] = value
        out.tag("vorbis", key, value)
    found = []
    for n, c in sorted(stamps.items()):
        if "time" not in c:
            continue
        m = _STAMP.fullmatch(c["time"].strip())
        if not m:
            out.warn(f"chapter {n} has no valid time")
            continue
        h, mi, s, f = m.groups()
        found.append({"id": str(n), "title": c.get("name") or f"Chapter {n}", "start": ((int(h) * 60 + int(mi)) * 60 + int(s)) * 1000 + int((f or "0").ljust(3, "0"))})
    out.chapters(with_ends(found, None))


def streaminfo(b: bytes, out: Events) -> None:
    if len(b) < 34:
        raise ContentError("FLAC", "STREAMINFO is too short")
    packed = int.from_bytes(b[10:18], "big")
    rate, channels, bits, samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    out.format(sampleRate=rate, numberOfChannels=channels, bitsPerSample=bits, lossless=True, audioMD5=b[18:34], hasAudio=True)
    if samples and rate:
        out.format(numberOfSamples=samples, duration=samples / rate)


def cuesheet(b: bytes, out: Events) -> None:
    if len(b) < 396:
        return
    rate = out.known.get("sampleRate") or 1
    at, found, end = 396, [], None
    for _ in range(b[395]):
        (offset,) = unpack(">Q", b, at)
        number, points = b[at + 8], b[at + 35]
        index1 = 0
        for k in range(points):
            p = at + 36 + 12 * k
            if b[p + 8] == 1:
                (index1,) = unpack(">Q", b, p)
                break
        if number in (0xAA, 0xFF):
            end = round_half_up(offset * 1000 / rate)
        else:
            start = offset + index1
            found.append({"id": str(number), "title": f"Track {number:02d}", "start": round_half_up(start * 1000 / rate), "sample_offset": start})
        at += 36 + 12 * points
    out.chapters(with_ends(found, end))


def flac_blocks(b: bytes, at: int, out: Events) -> int:
    """Metadata blocks from ``at`` on; returns the offset of the audio."""
    while at + 4 <= len(b):
        head, size = b[at], int.from_bytes(b[at + 1 : at + 4], "big")
        body = b[at + 4 : at + 4 + size]
        kind = head & 127
        if kind == 0:
            streaminfo(body, out)
        elif kind == 4:
            comments(body, out)
        elif kind == 5:
            cuesheet(body, out)
        elif kind == 6:
            picture_block(body, out)
        elif kind not in (1, 2, 3):
            out.warn(f"unknown FLAC block {kind}")
        at += 4 + size
        if head & 128:
            break
    return at


def flac(b: bytes, out: Events) -> None:
    at = id3v2(b, 0, out)
    if b[at : at + 4] != b"fLaC":
        raise ContentError("FLAC", "the fLaC mark is missing")
    out.format(container="FLAC", codec="FLAC")
    at = flac_blocks(b, at + 4, out)
    if out.known.get("duration"):
        out.format(bitrate=float(round_half_up(8 * (len(b) - at) / out.known["duration"])))


#: Bytes at the end of a file in which its last page begins; a page has no more.
TAIL = 27 + 255 + 255 * 255


def pages(b: bytes):
    """(serial, granule, flags, segments, place of the payload) of each page."""
    at = 0
    while at + 27 <= len(b):
        if b[at : at + 4] != b"OggS":
            raise ContentError("Ogg", "a page doesn't begin with OggS")
        flags = b[at + 5]
        granule, serial = unpack("<qI", b, at + 6)
        lacing = b[at + 27 : at + 27 + b[at + 26]]
        size = sum(lacing)
        start = at + 27 + len(lacing)
        yield serial, granule, flags, lacing, start
        at = start + size


def last_pages(b: bytes) -> list[tuple[int, int]]:
    """(serial, granule) of the pages in the last bytes of a file."""
    tail = b[max(0, len(b) - TAIL) :]
    found, at = [], tail.find(b"OggS")
    while at >= 0 and at + 18 <= len(tail):
        granule, serial = unpack("<qI", tail, at + 6)
        if tail[at + 4] == 0 and tail[at + 5] < 8:
            found.append((serial, granule))
        at = tail.find(b"OggS", at + 4)
    return found


class Stream:
    def __init__(self) -> None:
        self.codec = ""
        self.packets: list[bytes] = []
        self.part = b""
        self.granule = 0
        self.closed = False
        self.rate = 0
        self.pre_skip = 0

    def feed(self, lacing: bytes, data: bytes) -> list[bytes]:
        """Whole packets that end in this page; a packet may span pages."""
        done, at = [], 0
        for n in lacing:
            self.part += data[at : at + n]
            at += n
            if n < 255:
                done.append(self.part)
                self.part = b""
        return done


def ogg(b: bytes, out: Events) -> None:
    out.format(container="Ogg")
    streams: dict[int, Stream] = {}
    seen = 0
    for serial, granule, flags, lacing, start in pages(b):
        s = streams.setdefault(serial, Stream())
        if len(s.packets) < 3 and s.codec != "done":
            for packet in s.feed(lacing, b[start : start + sum(lacing)]):
                s.packets.append(packet)
                _packet(s, len(s.packets), packet, out)
        if granule > s.granule:
            s.granule = granule
        s.closed = s.closed or bool(flags & 4)
        seen += 1
        if all(x.closed for x in streams.values()):
            break
        if getattr(b, "sparse", False) and granule > 0 and all(len(x.packets) >= 2 for x in streams.values()):
            # the headers are read: the lengths stand on the last pages
            ends = last_pages(b)
            if ends and {x for x, _ in ends} <= streams.keys():
                for serial, granule in ends:
                    streams[serial].granule = max(granule, streams[serial].granule)
                    streams[serial].closed = True
                break
    if not seen:
        raise ContentError("Ogg", "there is no page")
    for s in streams.values():
        if not s.closed:
            out.warn("an Ogg stream ends without its last page")
        if s.rate and s.granule:
            out.format(numberOfSamples=s.granule - s.pre_skip, duration=(s.granule - s.pre_skip) / s.rate)
    if out.known.get("duration") and "bitrate" not in out.known:
        out.format(bitrate=8 * len(b) / out.known["duration"])


def _packet(s: Stream, n: int, p: bytes, out: Events) -> None:
    if n == 1:
        if p[:7] == b"\x01vorbis":
            channels, rate, _, nominal, _ = unpack("<BIiii", p, 11)
            s.codec, s.rate = "vorbis", rate
            out.format(codec="Vorbis I", sampleRate=rate, numberOfChannels=channels, bitrate=float(nominal) if nominal > 0 else None, hasAudio=True)
        elif p[:8] == b"OpusHead":
            channels, skip, rate = unpack("<BHI", p, 9)
            s.codec, s.rate, s.pre_skip = "opus", 48000, skip
            out.format(codec="Opus", sampleRate=rate or 48000, numberOfChannels=channels, hasAudio=True)
        elif p[:8] == b"Speex   ":
            rate, _, _, channels, bitrate = unpack("<IIIIi", p, 36)
            s.codec, s.rate = "speex", rate
            out.format(codec="Speex " + p[8:28].split(b"\x00")[0].decode("latin-1"), sampleRate=rate, numberOfChannels=channels, bitrate=float(bitrate) if bitrate > 0 else None, hasAudio=True)
        elif p[:5] == b"\x7fFLAC":
            s.codec = "flac"
            out.format(codec="FLAC")
            flac_blocks(p, 13, out)
            s.rate = out.known.get("sampleRate", 0)
        elif p[:7] == b"\x80theora" or p[:7] == b"fishead":
            s.codec = "theora"
            out.format(codec="Theora", hasVideo=True)
            if p[:7] == b"\x80theora" and len(p) >= 40:
                out.format(bitrate=float(int.from_bytes(p[37:40], "big")) or None)
        else:
            out.warn("unknown Ogg codec")
        return
    try:
        if s.codec == "vorbis" and p[:7] == b"\x03vorbis":
            comments(p, out, 7)
        elif s.codec == "opus" and p[:8] == b"OpusTags":
            comments(p, out, 8)
        elif s.codec == "speex" and n == 2:
            comments(p, out)
        elif s.codec == "flac" and p and p[0] & 127 in (4, 5, 6):
            flac_blocks(p, 0, out)
    except ContentError as e:
        out.warn(f"comment header: {e}")
