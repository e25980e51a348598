"""MPEG audio frames (layers 1 to 3) and ADTS, with Xing, LAME and ID3 around them."""

from __future__ import annotations

from tagloom.sources.decode.ape import ape_tag
from tagloom.sources.decode.events import ContentError, Events, round_half_up, unpack
from tagloom.sources.decode.id3 import id3v1, id3v2
from tagloom.sources.fixed_layout import AAC_CHANNELS, AAC_PROFILES, AAC_RATES, KBIT, RATES

_VERSIONS = {0: 2.5, 2: 2.0, 3: 1.0}

# Fixed value: bytes a Lyrics3 v2 block has at most.
_LYRICS3_MOST = 102_400


class Frame:
    """A frame header; ``ok`` is false where the four bytes are none."""

    def __init__(self, b: bytes, at: int) -> None:
        self.ok = False
        if at + 4 > len(b) or b[at] != 255 or b[at + 1] & 224 != 224:
            return
        h1, h2, h3 = b[at + 1], b[at + 2], b[at + 3]
        version, layer = _VERSIONS.get(h1 >> 3 & 3), 4 - (h1 >> 1 & 3)
        ri, si = h2 >> 4, h2 >> 2 & 3
        if version is None or layer == 4 or ri in (0, 15) or si == 3:
            return
        self.bitrate = KBIT[ri - 1][layer - 1 + (0 if version == 1.0 else 3)] * 1000
        self.rate = RATES[version][si]
        self.samples = 384 if layer == 1 else 576 if layer == 3 and version != 1.0 else 1152
        self.size = int(self.samples / 8 * self.bitrate / self.rate + (h2 >> 1 & 1) * (4 if layer == 1 else 1))
        self.mono, self.crc = h3 >> 6 == 3, not h1 & 1
        self.version, self.layer = version, layer
        self.side = 2 if layer != 3 else (17 if self.mono else 32) if version == 1.0 else (9 if self.mono else 17)
        self.codec = f"MPEG {version:g} Layer {layer}"
        self.ok = self.size > 4


def adts_size(b: bytes, at: int) -> int:
    return (b[at + 3] & 3) << 11 | b[at + 4] << 3 | b[at + 5] >> 5


def is_adts(b: bytes, at: int) -> bool:
    return at + 7 <= len(b) and b[at] == 255 and b[at + 1] & 246 == 240 and adts_size(b, at) > 7


def xing(b: bytes, at: int, f: Frame, out: Events) -> bool:
    """VBR header of the first frame; returns whether it told the length."""
    p = at + 4 + (2 if f.crc else 0) + f.side
    mark = b[p : p + 4]
    if mark not in (b"Xing", b"Info"):
        return False
    (flags,) = unpack(">I", b, p + 4)
    q, frames, size, scale = p + 8, None, None, None
    if flags & 1:
        (frames,) = unpack(">I", b, q)
        q += 4
    if flags & 2:
        (size,) = unpack(">I", b, q)
        q += 4
    q += 100 if flags & 4 else 0
    if flags & 8:
        (scale,) = unpack(">I", b, q)
        q += 4
    out.format(codecProfile="CBR" if mark == b"Info" else f"V{(100 - scale) // 10}" if scale is not None else "VBR")
    if b[q : q + 4] == b"LAME":
        out.format(tool="LAME " + b[q + 4 : q + 9].decode("latin-1").strip("\x00 "))
        if q + 27 <= len(b):
            peak, one, two = unpack(">IHH", b, q + 11)
            if peak:
                out.format(trackPeakLevel=peak / (1 << 23))
            for word in (one, two):
                gain = (word & 511) / 10 * (-1 if word >> 9 & 1 else 1)
                if word >> 13 == 1:
                    out.format(trackGain=gain)
                elif word >> 13 == 2:
                    out.format(albumGain=gain)
    if frames:
        seconds = frames * f.samples / f.rate
        out.format(numberOfSamples=frames * f.samples, duration=seconds)
        if size and mark == b"Xing":
            out.format(bitrate=8 * size / seconds)
        return True
    return False


def mpeg(b: bytes, out: Events) -> None:
    start = id3v2(b, 0, out)
    at = start
    while at + 4 <= len(b) and not (Frame(b, at).ok or is_adts(b, at)):
        at = b.find(b"\xff", at + 1)
        if at < 0:
            break
    if at < 0 or at + 4 > len(b):
        if start == 0 and not id3v1(b, out):
            raise ContentError("MPEG", "there is no frame")
    elif is_adts(b, at):
        _adts(b, at, out)
    else:
        _frames(b, at, out)
    if not out.options.skip_post_headers:
        ape_tag(b, out)
        if start or at >= 0:
            id3v1(b, out)


def lyrics3(b: bytes, out: Events) -> None:
    """A decoder of its own, which no file finds by its keys: the records of a Lyrics3 v2 block at the end of the bytes, in front of an ID3v1 block where there is one; larger blocks than the format allows are none."""
    end = len(b) - 128 if b[-128:-125] == b"TAG" else len(b)
    if end < 26 or b[end - 9 : end] != b"LYRICS200" or not b[end - 15 : end - 9].isdigit():
        return
    size = int(b[end - 15 : end - 9])
    body = b[max(0, end - 15 - size) : end - 15]
    if size > _LYRICS3_MOST or body[:11] != b"LYRICSBEGIN":
        return
    at = 11
    while at + 8 <= len(body) and body[at + 3 : at + 8].isdigit():
        n = int(body[at + 3 : at + 8])
        out.tag("Lyrics3", body[at : at + 3].decode("latin-1"), body[at + 8 : at + 8 + n].decode("latin-1"))
        at += 8 + n


def _frames(b: bytes, at: int, out: Events) -> None:
    first, begin = Frame(b, at), at
    out.format(container="MPEG", codec=first.codec, lossless=False, sampleRate=first.rate, numberOfChannels=1 if first.mono else 2, bitrate=float(first.bitrate), hasAudio=True)
    if xing(b, at, first, out) and not out.options.duration:
        return
    rates, n, samples = [], 0, 0
    while True:
        f = Frame(b, at)
        if not f.ok:
            break
        n += 1
        samples += f.samples
        rates.append(f.bitrate)
        at += f.size
        if n == 3 and not out.options.duration and len(set(rates)) == 1:
            break
    if out.known.get("duration"):
        return
    end = len(b) - (128 if b[-128:-125] == b"TAG" else 0)
    if len(set(rates)) == 1:
        out.format(codecProfile="CBR")
        samples = round_half_up((end - begin) / first.size) * first.samples
    out.format(numberOfSamples=samples, duration=samples / first.rate, bitrate=float(rates[0]) if len(set(rates)) == 1 else 8 * (at - begin) / (samples / first.rate))


def _adts(b: bytes, at: int, out: Events) -> None:
    h2, h3 = b[at + 2], b[at + 3]
    si = h2 >> 2 & 15
    rate = AAC_RATES[si] if si < len(AAC_RATES) else None
    out.format(container="ADTS/MPEG-" + ("2" if b[at + 1] & 8 else "4"), codec="AAC", codecProfile=AAC_PROFILES[h2 >> 6], sampleRate=rate, numberOfChannels=AAC_CHANNELS[(h2 & 1) << 2 | h3 >> 6], hasAudio=True, lossless=False)
    n = total = 0
    while is_adts(b, at):
        total += adts_size(b, at)
        at += adts_size(b, at)
        n += 1
        if n == 3 and not out.options.duration:
            break
    if rate and n:
        out.format(bitrate=float(round_half_up(8 * (total / n) * rate / 1024)))
        if out.options.duration:
            out.format(numberOfSamples=n * 1024, duration=n * 1024 / rate)
