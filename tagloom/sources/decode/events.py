"""Event rows, options and byte helpers shared by the decoders."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

SCHEMA = "file_id long, seq int, kind string, format_id string, tag_id string, v_str string, v_int long, v_dbl double, v_bool boolean, v_bin binary, v_list array<string>, v_json string"


class ContentError(Exception):
    """The bytes are not what the loader expects."""

    def __init__(self, file_type: str, message: str) -> None:
        super().__init__(message)
        self.file_type = file_type


@dataclass(frozen=True)
class Options:
    skip_covers: bool = False
    skip_post_headers: bool = False
    include_chapters: bool = False
    duration: bool = False
    split_slash: bool = True


PRESETS = {"all": Options(duration=True, include_chapters=True), "minimal": Options(skip_covers=True, skip_post_headers=True), "metadata_only": Options()}


@dataclass
class Events:
    """Collects the rows of one file; seq is assigned here, so order never depends on Spark."""

    options: Options = field(default_factory=Options)
    size: int | None = None
    rows: list[tuple] = field(default_factory=list)
    known: dict = field(default_factory=dict)

    def _add(self, kind: str, format_id: str | None, tag_id: str | None, value, extra=None) -> None:
        s = i = d = b = raw = lst = None
        if isinstance(value, bool):
            b = value
        elif isinstance(value, int):
            i = value if -(1 << 63) <= value < 1 << 63 else None
        elif isinstance(value, float):
            d = value
        elif isinstance(value, bytes):
            raw = value
        elif isinstance(value, list):
            lst = [str(x) for x in value]
        elif value is not None:
            s = str(value)
        self.rows.append((len(self.rows), kind, format_id, tag_id, s, i, d, b, raw, lst, json.dumps(extra, ensure_ascii=False) if extra is not None else None))

    def format(self, **fields) -> None:
        for name, value in fields.items():
            if value is not None:
                self.known[name] = value
                self._add("format", None, name, value)

    def tag(self, format_id: str, tag_id: str, value, extra=None) -> None:
        if value is not None:
            self._add("tag", format_id, tag_id, value, extra)

    def picture(self, format_id: str, tag_id: str, data: bytes, mime: str | None, kind: str | None = None, description: str | None = None) -> None:
        if not self.options.skip_covers:
            self._add("picture", format_id, tag_id, bytes(data), {"format": mime, "type": kind, "description": description, "length": len(data)})

    def chapters(self, found: list[dict]) -> None:
        if self.options.include_chapters:
            for c in found:
                self._add("chapter", None, c.get("id"), c.get("title"), {k: v for k, v in c.items() if v is not None})

    def track(self, info: dict) -> None:
        self._add("track", None, str(info.get("type")), info.get("codec"), info)

    def warn(self, message: str) -> None:
        self._add("warning", None, None, message)


# Picture types by number.
PICTURE_TYPES = ["Other", "32x32 pixels 'file icon' (PNG only)", "Other file icon", "Cover (front)", "Cover (back)", "Leaflet page", "Media (e.g. label side of CD)", "Lead artist/lead performer/soloist", "Artist/performer", "Conductor", "Band/Orchestra", "Composer", "Lyricist/text writer", "Recording Location", "During recording", "During performance", "Movie/video screen capture", "A bright coloured fish", "Illustration", "Band/artist logotype", "Publisher/Studio logotype"]


def picture_type(n: int) -> str:
    return PICTURE_TYPES[n] if n < len(PICTURE_TYPES) else PICTURE_TYPES[0]


def picture_mime(data: bytes) -> str | None:
    for mark, mime in ((b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG", "image/png"), (b"GIF", "image/gif")):
        if data.startswith(mark):
            return mime
    return None


def unpack(fmt: str, b: bytes, at: int = 0) -> tuple:
    """struct.unpack_from that reports short input as a content error."""
    try:
        return struct.unpack(fmt, b[at : at + struct.calcsize(fmt)])
    except struct.error:
        raise ContentError("data", f"{len(b)} bytes are too few for {fmt} at {at}") from None


def round_half_up(x: float) -> int:
    """Rounds halves away from zero."""
    return int(x + 0.5) if x >= 0 else -int(-x + 0.5)


def clean(text: str) -> str:
    return text.split("\x00", 1)[0].strip()


def with_ends(chapters: list[dict], last: int | None) -> list[dict]:
    """Sorted by start; a chapter without an end takes the next start, the last one ``last``."""
    found = sorted(chapters, key=lambda c: c["start"])
    for a, b in zip(found, found[1:]):
        a.setdefault("end", b["start"])
    if found and "end" not in found[-1] and last is not None:
        found[-1]["end"] = last
    return found
