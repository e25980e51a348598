"""Matroska and WebM by EBML elements."""

from __future__ import annotations

import math
import struct

from tagloom.sources.decode.events import ContentError, Events, round_half_up, with_ends

# Element | id | kind (m holds elements, u unsigned, f float, s text, b bytes, x bytes as hex digits).
_ELEMENTS = """
EBML 1A45DFA3 m | DocType 4282 s | Segment 18538067 m | Info 1549A966 m | TimecodeScale 2AD7B1 u | Duration 4489 f | Title 7BA9 s | MuxingApp 4D80 s | WritingApp 5741 s
Tracks 1654AE6B m | TrackEntry AE m | TrackNumber D7 u | TrackUID 73C5 u | TrackType 83 u | FlagEnabled B9 u | FlagDefault 88 u | FlagLacing 9C u | Name 536E s | Language 22B59C s
CodecID 86 s | CodecName 258688 s | Audio E1 m | SamplingFrequency B5 f | OutputSamplingFrequency 78B5 f | Channels 9F u | BitDepth 6264 u | Video E0 m | PixelWidth B0 u | PixelHeight BA u
DisplayWidth 54B0 u | DisplayHeight 54BA u | Tags 1254C367 m | Tag 7373 m | Targets 63C0 m | TargetTypeValue 68CA u | TargetType 63CA s | SimpleTag 67C8 m | TagName 45A3 s | TagString 4487 s | TagBinary 4485 b
Attachments 1941A469 m | AttachedFile 61A7 m | FileDescription 467E s | FileName 466E s | FileMimeType 4660 s | FileData 465C b
Chapters 1043A770 m | EditionEntry 45B9 m | ChapterAtom B6 m | ChapterUID 73C4 x | ChapterTimeStart 91 u | ChapterTimeEnd 92 u | ChapterDisplay 80 m | ChapString 85 s | ChapLanguage 437C s | ChapterTrack 8F m
SeekHead 114D9B74 m | Seek 4DBB m | SeekID 53AB b | SeekPosition 53AC u
"""
_DTD = {int(i, 16): (name, kind) for name, i, kind in (e.split() for line in _ELEMENTS.strip().split("\n") for e in line.split("|"))}
_SKIP = {0x1C53BB6B, 0xEC, 0xBF}
_CLUSTER = 0x1F43B675
_TARGETS = {10: "shot", 20: "scene", 30: "track", 40: "part", 50: "album", 60: "edition", 70: "collection"}
_TYPES = {1: "video", 2: "audio", 3: "complex", 4: "logo", 16: "subtitle", 17: "button", 18: "control"}


def vint(b: bytes, at: int, keep_mark: bool) -> tuple[int, int]:
    if at >= len(b) or not b[at]:
        raise ContentError("EBML", "invalid variable-length number")
    n = 9 - b[at].bit_length()
    v = int.from_bytes(b[at : at + n], "big")
    if not keep_mark:
        v &= (1 << 7 * n) - 1
        if v == (1 << 7 * n) - 1:
            v = -1
    return v, at + n


def _number(p: bytes) -> float:
    """Floats of 4, 8 and 10 bytes; others are 0."""
    if len(p) == 10:
        head, fraction = struct.unpack(">HQ", p)
        return (-1 if head >> 15 else 1) * math.ldexp(fraction, (head & 0x7FFF) - 16383 - 63)
    return struct.unpack(">d" if len(p) == 8 else ">f", p)[0] if len(p) in (4, 8) else 0.0


def next_seek(found: dict, base: int, at: int) -> int | None:
    """The smallest position behind ``at`` that the seek table of a segment names."""
    places = [base + one(s, "SeekPosition", 0) for h in found.get("SeekHead", []) for s in h.get("Seek", [])]
    return min((x for x in places if x > at), default=None)


def tree(b: bytes, at: int, end: int) -> dict:
    """Elements of [at, end) as name -> list of values; unknown ones are skipped. At a cluster the walk goes on where the
    seek table says; without one, behind the cluster, and a cluster of unknown size ends it."""
    found: dict[str, list] = {}
    base = at
    while at < end:
        here = at
        ident, at = vint(b, at, True)
        size, at = vint(b, at, False)
        stop = end if size < 0 else min(at + size, end)
        if ident == _CLUSTER:
            jump = next_seek(found, base, here)
            at = jump if jump is not None and jump < end else stop
            continue
        if ident in _DTD and ident not in _SKIP:
            name, kind = _DTD[ident]
            p = b[at:stop] if kind != "m" else b""
            if kind == "m":
                v = tree(b, at, stop)
            elif kind == "x":
                v = p.hex()
            elif kind == "u":
                v = int.from_bytes(p, "big")
            elif kind == "f":
                v = _number(p)
            elif kind == "s":
                v = p.decode("utf-8", "replace").rstrip("\x00")
            else:
                v = p
            found.setdefault(name, []).append(v)
        at = stop
    return found


def one(t: dict, name: str, default=None):
    return t.get(name, [default])[0]


def matroska(b: bytes, out: Events) -> None:
    if b[:4] != b"\x1a\x45\xdf\xa3":
        raise ContentError("Matroska", "the EBML mark is missing")
    t = tree(b, 0, len(b))
    out.format(container=f"EBML/{one(one(t, 'EBML', {}), 'DocType', 'matroska')}")
    for segment in t.get("Segment", []):
        _segment(segment, out)


def _segment(s: dict, out: Events) -> None:
    info = one(s, "Info", {})
    scale = one(info, "TimecodeScale", 1000000)
    if one(info, "Duration"):
        out.format(duration=one(info, "Duration") * scale / 1e9)
    if one(info, "Title"):
        out.tag("matroska", "segment:title", one(info, "Title"))
    audio = []
    for e in (x for t in s.get("Tracks", []) for x in t.get("TrackEntry", [])):
        a, v = one(e, "Audio"), one(e, "Video")
        kind = _TYPES.get(one(e, "TrackType", 0))
        codec = one(e, "CodecID", "").removeprefix("A_").removeprefix("V_").removeprefix("S_")
        out.track({"type": kind, "codec": codec, "name": one(e, "Name"), "language": one(e, "Language"), "enabled": one(e, "FlagEnabled", 1) == 1, "default": one(e, "FlagDefault", 1) == 1, "width": one(v, "PixelWidth") if v else None, "height": one(v, "PixelHeight") if v else None})
        if kind == "audio":
            audio.append((one(e, "FlagDefault", 1) != 1, one(e, "TrackNumber", 0), codec, a or {}))
        if kind in ("audio", "video"):
            out.format(**{"hasAudio" if kind == "audio" else "hasVideo": True})
    if audio:
        _, _, codec, a = min(audio, key=lambda x: x[:2])
        out.format(codec=codec, sampleRate=int(one(a, "SamplingFrequency", 0)) or None, numberOfChannels=one(a, "Channels"), bitsPerSample=one(a, "BitDepth"))
    for tag in (x for t in s.get("Tags", []) for x in t.get("Tag", [])):
        target = one(tag, "Targets", {})
        level = _TARGETS.get(one(target, "TargetTypeValue", 50)) or one(target, "TargetType", "track")
        for x in tag.get("SimpleTag", []):
            out.tag("matroska", f"{level}:{one(x, 'TagName', '')}", one(x, "TagString", one(x, "TagBinary")))
    for f in (x for a in s.get("Attachments", []) for x in a.get("AttachedFile", [])):
        if one(f, "FileMimeType", "").startswith("image/"):
            out.picture("matroska", "picture", one(f, "FileData", b""), one(f, "FileMimeType"), None, one(f, "FileDescription"))
    found = []
    for c in (x for ch in s.get("Chapters", []) for e in ch.get("EditionEntry", []) for x in e.get("ChapterAtom", [])):
        shown = one(c, "ChapterDisplay") or one(one(c, "ChapterTrack", {}), "ChapterDisplay") or {}
        item = {"id": str(one(c, "ChapterUID", "")), "title": one(shown, "ChapString", "Chapter"), "start": round_half_up(one(c, "ChapterTimeStart", 0) / 1e6)}
        if one(c, "ChapterTimeEnd") is not None:
            item["end"] = round_half_up(one(c, "ChapterTimeEnd") / 1e6)
        found.append(item)
    last = out.known.get("duration")
    out.chapters(with_ends(found, round_half_up(last * 1000) if last else None))
