"""MP4 family: atoms, tracks, iTunes items, chapter lists and chapter tracks."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from tagloom.sources.decode.events import ContentError, Events, picture_mime, round_half_up, unpack, with_ends

# Atoms that hold atoms; sample entries and their codec names; lossless codecs; chapter clocks.
_HOLDERS = {b"moov", b"udta", b"meta", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"ilst", b"tref", b"moof"}
_CODECS = {"mp4a": "MPEG-4/AAC", "alac": "ALAC", "ac-3": "AC-3", "ec-3": "EAC-3", "raw ": "raw", "MAC3": "MACE 3:1", "MAC6": "MACE 6:1", "ima4": "IMA 4:1", "ulaw": "uLaw 2:1", "alaw": "aLaw 2:1", ".mp3": "MP3", "fLaC": "FLAC", "Opus": "Opus"}
_LOSSLESS = {"alac", "fLaC", "raw "}
_CLOCKS = [1000, 22050, 44100, 48000, 90000, 1000000, 10000000]


@dataclass
class Track:
    ident: int = 0
    handler: str = ""
    scale: int = 0
    duration: int = 0
    entry: str = ""
    channels: int = 0
    bits: int = 0
    rate: int = 0
    stts: list = field(default_factory=list)
    stsc: list = field(default_factory=list)
    stsz: list = field(default_factory=list)
    offsets: list = field(default_factory=list)
    chapter_ids: list = field(default_factory=list)


def atoms(b: bytes, lo: int, hi: int):
    """(name, payload start, payload end) of the atoms in [lo, hi)."""
    while lo + 8 <= hi:
        size, name = int.from_bytes(b[lo : lo + 4], "big"), b[lo + 4 : lo + 8]
        head = 8
        if size == 1:
            size, head = int.from_bytes(b[lo + 8 : lo + 16], "big"), 16
        elif size == 0:
            size = hi - lo
        if size < head:
            return
        yield name, lo + head, min(lo + size, hi)
        lo += size


class Reader:
    def __init__(self, b: bytes, out: Events) -> None:
        self.b, self.out = b, out
        self.tracks: list[Track] = []
        self.movie_seconds: float | None = None
        self.mdat = 0
        self.chpl: list[tuple[int, str]] = []

    def run(self) -> None:
        first = True
        for name, lo, hi in atoms(self.b, 0, len(self.b)):
            if first and name not in (b"ftyp", b"moov", b"free", b"mdat", b"wide", b"skip"):
                raise ContentError("MP4", "the file doesn't begin with an MP4 atom")
            first = False
            self.atom(name, lo, hi, ())
        if first:
            raise ContentError("MP4", "there is no atom")
        self.finish()

    def atom(self, name: bytes, lo: int, hi: int, path: tuple) -> None:
        p = self.b[lo:hi] if name not in (b"mdat", b"free", b"skip", b"wide") else b""
        if name == b"mdat":
            self.mdat += hi - lo
        elif path[-1:] == (b"ilst",):
            self.item(name, lo, hi)
        elif name in _HOLDERS:
            if name == b"trak":
                self.tracks.append(Track())
            start = lo + 4 if name == b"meta" and p[4:8] != b"hdlr" else lo
            for n, a, z in atoms(self.b, start, hi):
                self.atom(n, a, z, (*path, name))
        elif name == b"ftyp":
            self.brands(p)
        else:
            try:
                self.leaf(name, p, self.tracks[-1] if b"trak" in path and self.tracks else None)
            except ContentError as e:
                self.out.warn(f"atom {name.decode('latin-1')}: {e}")

    def brands(self, p: bytes) -> None:
        words = [re.sub(r"\W", "", p[i : i + 4].decode("latin-1")) for i in range(0, len(p), 4)]
        self.out.format(container="/".join(dict.fromkeys(w for w in words if w)) or None)

    def leaf(self, name: bytes, p: bytes, t: Track | None) -> None:
        if name in (b"mvhd", b"mdhd"):
            created, modified, scale, duration = unpack(">QQIQ" if p[:1] == b"\x01" else ">IIII", p, 4)
            if name == b"mvhd":
                self.movie_seconds = duration / scale if scale else None
                self.out.format(creationTime=created or None, modificationTime=modified or None)
            elif t:
                t.scale, t.duration = scale, duration
        elif name == b"chpl":
            self.nero(p)
        elif t is None:
            return
        elif name == b"tkhd":
            (t.ident,) = unpack(">I", p, 20 if p[:1] == b"\x01" else 12)
        elif name == b"hdlr":
            t.handler = p[8:12].decode("latin-1")
        elif name == b"stsd":
            t.entry = p[12:16].decode("latin-1")
            if len(p) >= 44:
                t.channels, t.bits, _, _, rate = unpack(">HHHHI", p, 32)
                t.rate = rate >> 16
        elif name in (b"stts", b"stsc", b"stco", b"co64", b"stsz"):
            self.table(name, p, t)
        elif name == b"chap":
            t.chapter_ids = [int.from_bytes(p[i : i + 4], "big") for i in range(0, len(p) - 3, 4)]

    def table(self, name: bytes, p: bytes, t: Track) -> None:
        if name == b"stsz":
            size, n = unpack(">II", p, 4)
            t.stsz = [size] * n if size else list(unpack(f">{min(n, (len(p) - 12) // 4)}I", p, 12))
            return
        (n,) = unpack(">I", p, 4)
        width = {b"stts": 2, b"stsc": 3, b"stco": 1, b"co64": 1}[name]
        code, size = ("Q", 8) if name == b"co64" else ("I", 4)
        n = min(n, (len(p) - 8) // (size * width))
        flat = unpack(f">{n * width}{code}", p, 8)
        if name == b"stts":
            t.stts = list(zip(flat[::2], flat[1::2]))
        elif name == b"stsc":
            t.stsc = list(zip(flat[::3], flat[1::3]))
        else:
            t.offsets = list(flat)

    def item(self, name: bytes, lo: int, hi: int) -> None:
        key = name.decode("latin-1")
        mean = label = None
        values = []
        for n, a, z in atoms(self.b, lo, hi):
            p = self.b[a:z]
            if n == b"mean":
                mean = p[4:].decode("utf-8", "replace")
            elif n == b"name":
                label = p[4:].decode("utf-8", "replace")
            elif n == b"data" and len(p) >= 8:
                values.append((int.from_bytes(p[1:4], "big"), p[8:]))
        if key == "----":
            key = f"----:{mean}:{label}"
        for kind, v in values:
            if kind in (13, 14) or kind == 0 and name == b"covr":
                self.out.picture("iTunes", key, v, {13: "image/jpeg", 14: "image/png"}.get(kind) or picture_mime(v))
            else:
                self.out.tag("iTunes", key, self.value(key, kind, v))

    @staticmethod
    def value(key: str, kind: int, v: bytes):
        if kind == 1:
            return v.decode("utf-8", "replace")
        if kind == 18:
            return v.decode("utf-16-be", "replace")
        if kind == 2:
            return v.decode("utf-16-be", "replace")
        if kind in (21, 22, 65, 66, 67) and 1 <= len(v) <= 8:
            n = int.from_bytes(v, "big", signed=kind != 22)
            return n if -(1 << 31) <= n < 1 << 31 else None
        if kind == 0:
            if key in ("trkn", "disk") and len(v) >= 6:
                return f"{int.from_bytes(v[2:4], 'big')}/{int.from_bytes(v[4:6], 'big')}"
            if len(v) <= 4:
                return int.from_bytes(v, "big")
        return v

    def nero(self, p: bytes) -> None:
        """Chapter list: 64-bit stamps in version 1, their low 32 bits count in version 0."""
        version = p[0]
        at = 8 if version else 4
        n = p[at] if at < len(p) else 0
        at += 1
        for _ in range(n):
            if at + 9 > len(p):
                break
            (stamp,) = unpack(">Q", p, at)
            size = p[at + 8]
            self.chpl.append((stamp if version else stamp & 0xFFFFFFFF, p[at + 9 : at + 9 + size].decode("utf-8", "replace")))
            at += 9 + size

    # timing

    @staticmethod
    def chunk_starts(t: Track) -> list[int]:
        """First sample of each chunk."""
        starts, sample = [], 0
        firsts = [f for f, _ in t.stsc]
        for chunk in range(1, len(t.offsets) + 1):
            starts.append(sample)
            i = max(0, bisect_left(firsts, chunk + 1) - 1)
            sample += t.stsc[i][1] if t.stsc else 0
        return starts

    @staticmethod
    def time_of(t: Track, sample: int) -> int | None:
        total = 0
        for count, d in t.stts:
            if sample < count:
                return total + sample * d
            total += count * d
            sample -= count
        return total if sample == 0 else None

    def finish(self) -> None:
        out = self.out
        audio = [t for t in self.tracks if t.handler in ("soun", "audi")]
        video = [t for t in self.tracks if t.handler == "vide"]
        out.format(hasAudio=bool(audio), hasVideo=bool(video))
        for t in self.tracks:
            out.track({"type": {"soun": "audio", "audi": "audio", "vide": "video"}.get(t.handler, t.handler), "codec": _CODECS.get(t.entry, t.entry)})
        seconds = self.movie_seconds
        if audio:
            a = audio[0]
            out.format(codec=_CODECS.get(a.entry, a.entry or None), lossless=a.entry in _LOSSLESS, sampleRate=a.rate or a.scale or None, numberOfChannels=a.channels or None, bitsPerSample=a.bits or None)
            if a.scale and a.duration:
                seconds = a.duration / a.scale
                out.format(numberOfSamples=a.duration)
        if seconds:
            out.format(duration=seconds, bitrate=8 * (self.mdat or len(self.b)) / seconds)
        if self.chpl:
            self.listed(seconds or 0.0)
        else:
            self.tracked(seconds)

    def listed(self, seconds: float) -> None:
        base = self.clock(max(s for s, _ in self.chpl), seconds) or 10000000
        found = [{"title": title or None, "start": stamp * 1000 // base, "time_scale": base} for stamp, title in self.chpl]
        found = sorted((c for c in found if not seconds or c["start"] <= (seconds + 5) * 1000), key=lambda c: c["start"])
        for n, c in enumerate(found, 1):
            c["title"] = c["title"] or f"Chapter {n}"
        self.out.chapters(with_ends(found, round_half_up(seconds * 1000) if seconds else None))

    @staticmethod
    def clock(largest: int, seconds: float) -> int | None:
        if not largest or seconds <= 0:
            return None
        inferred = round_half_up(largest / seconds)
        if inferred <= 0:
            return None
        near = min(_CLOCKS, key=lambda c: abs(c - inferred) / inferred)
        return near if abs(near - inferred) / inferred <= 0.02 else inferred

    def tracked(self, seconds: float | None) -> None:
        """A text track that exactly one other track names as its chapters."""
        owners = [t for t in self.tracks if t.chapter_ids]
        if len(owners) != 1:
            return
        texts = [t for t in self.tracks if t.ident in owners[0].chapter_ids]
        if len(texts) != 1 or not texts[0].scale:
            return
        t = texts[0]
        found = []
        for chunk, sample in enumerate(self.chunk_starts(t)):
            at = t.offsets[chunk]
            size = int.from_bytes(self.b[at : at + 2], "big")
            start = self.time_of(t, sample)
            if start is not None:
                found.append({"title": self.b[at + 2 : at + 2 + size].decode("utf-8", "replace"), "start": round_half_up(start * 1000 / t.scale), "sample_offset": start, "time_scale": t.scale})
        end = round_half_up(t.duration * 1000 / t.scale) if t.duration else None
        for c in with_ends(found, end):
            if c.get("end") is not None and c["end"] < c["start"]:
                c["end"] = max(c["start"], round_half_up((seconds or 0) * 1000))
        self.out.chapters(found)


def mp4(b: bytes, out: Events) -> None:
    Reader(b, out).run()
