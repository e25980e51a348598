"""Monkey's Audio, APEv2 tags, WavPack and Musepack."""

from __future__ import annotations

from tagloom.sources.decode.events import ContentError, Events, picture_mime, round_half_up, unpack
from tagloom.sources.decode.id3 import id3v2

# Fixed values.
_COVER = {"cover art (front)": "Cover (front)", "cover art (back)": "Cover (back)"}
_WV_RATES = [6000, 8000, 9600, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000, 192000]
_MPC_RATES = [44100, 48000, 37800, 32000]


def ape_items(b: bytes, at: int, count: int, out: Events) -> None:
    for _ in range(count):
        if at + 8 > len(b):
            out.warn("an APEv2 tag ends early")
            return
        size, flags = unpack("<II", b, at)
        end = b.find(b"\x00", at + 8)
        if end < 0:
            return
        key, value = b[at + 8 : end].decode("latin-1"), b[end + 1 : end + 1 + size]
        kind = flags >> 1 & 3
        if kind == 0:
            values = [v for v in value.decode("utf-8", "replace").split("\x00") if v]
            out.tag("APEv2", key, values if len(values) > 1 else values[0] if values else None)
        elif kind == 1:
            name, _, data = value.partition(b"\x00")
            if key.lower() in _COVER:
                out.picture("APEv2", key, data, picture_mime(data), _COVER[key.lower()], name.decode("utf-8", "replace"))
            else:
                out.tag("APEv2", key, value)
        elif kind == 3:
            out.warn(f"reserved APEv2 item {key}")
        at = end + 1 + size


def ape_tag(b: bytes, out: Events) -> bool:
    """The APEv2 tag at the end of the bytes, in front of an ID3v1 block where there is one."""
    end = len(b) - 128 if b[-128:-125] == b"TAG" else len(b)
    if end < 32 or b[end - 32 : end - 24] != b"APETAGEX":
        return False
    _, size, count = unpack("<III", b, end - 24)
    ape_items(b[max(0, end - size) : end - 32], 0, count, out)
    return True


def monkeys_audio(b: bytes, out: Events) -> None:
    if b[:8] == b"APETAGEX":
        _, size, count = unpack("<III", b, 8)
        ape_items(b, 32, count, out)
        return
    if b[:4] != b"MAC ":
        raise ContentError("APEv2", "the MAC mark is missing")
    descriptor, header = unpack("<II", b, 8)
    blocks, last, frames, bits, channels, rate = unpack("<IIIHHI", b, descriptor + 4)
    samples = (frames - 1) * blocks + last if frames else 0
    out.format(container="Monkey's Audio", codec="Monkey's Audio", lossless=True, hasAudio=True, bitsPerSample=bits, numberOfChannels=channels, sampleRate=rate, numberOfSamples=samples)
    if rate and samples:
        (low, high) = unpack("<II", b, 24)
        out.format(duration=samples / rate, bitrate=8 * (high << 32 | low) / (samples / rate))
    ape_tag(b, out)


def wavpack(b: bytes, out: Events) -> None:
    at, audio, first = 0, 0, True
    while b[at : at + 4] == b"wvpk":
        size, _, _, _, total, index, samples, flags = unpack("<IHBBIIII", b, at + 4)
        if first:
            first = False
            dsd = bool(flags >> 31)
            k = flags >> 23 & 15
            rate = _WV_RATES[k] if k < len(_WV_RATES) else 0
            bits = 1 if dsd else ((flags & 3) + 1) * 8
            n = total
            if dsd:
                factor = _dsd_factor(b[at + 32 : at + 8 + size])
                rate, n = rate * factor * 8, total * factor * 8
            out.format(container="WavPack", codec="DSD" if dsd else "PCM", lossless=not flags >> 3 & 1, hasAudio=True, bitsPerSample=bits, numberOfChannels=1 if flags >> 2 & 1 else 2, sampleRate=rate or None, numberOfSamples=n, duration=n / rate if rate else None)
        for ident, data in _blocks(b[at + 32 : at + 8 + size]):
            if ident & 63 == 38:
                out.format(audioMD5=data[:16])
        if samples:
            audio += size + 8
        at += size + 8
    if first:
        raise ContentError("WavPack", "there is no wvpk block")
    if out.known.get("duration"):
        out.format(bitrate=float(round_half_up(audio * 8 / out.known["duration"])))
    ape_tag(b, out)


def _blocks(b: bytes):
    at = 0
    while at + 2 <= len(b):
        ident = b[at]
        if ident & 128:
            size, head = int.from_bytes(b[at + 1 : at + 4], "little") * 2, 4
        else:
            size, head = b[at + 1] * 2, 2
        yield ident, b[at + head : at + head + size - (1 if ident & 64 else 0)]
        at += head + size


def _dsd_factor(b: bytes) -> int:
    for ident, data in _blocks(b):
        if ident & 63 == 14 and data:
            return 1 << data[0]
    return 1


def musepack(b: bytes, out: Events) -> None:
    at = id3v2(b, 0, out)
    head = b[at : at + 4]
    if head[:3] == b"MP+":
        frames, flags = unpack("<II", b, at + 4)
        (tail,) = unpack("<I", b, at + 20)
        bits = Bits(b, at + 24)
        version = bits.read(8)
        last = tail >> 20 & 2047
        rate = _MPC_RATES[flags >> 16 & 3]
        samples = 1152 * (frames - 1) + last if frames else 0
        out.format(container="Musepack, SV7", codec=f"{version / 100:.2f}", sampleRate=rate, numberOfChannels=2, numberOfSamples=samples, hasAudio=True, lossless=False)
        if samples:
            out.format(duration=samples / rate)
            audio = 0
            for _ in range(frames):
                n = bits.read(20)
                bits.at += n
                audio += 20 + n
            out.format(bitrate=float(round_half_up((audio + bits.read(11)) / (samples / rate))))
    elif head == b"MPCK":
        _packets(b, at + 4, out)
    else:
        raise ContentError("Musepack", "neither MP+ nor MPCK")
    ape_tag(b, out)


class Bits:
    """Numbers of any width, the highest bit first, in little-endian words of 32 bits."""

    def __init__(self, b: bytes, start: int) -> None:
        self.b, self.start, self.at = b, start, 0

    def read(self, width: int) -> int:
        first, last = self.at // 32, (self.at + max(width, 1) - 1) // 32
        words = unpack(f"<{last - first + 1}I", self.b, self.start + 4 * first)
        value = 0
        for w in words:
            value = value << 32 | w
        value >>= 32 * len(words) - self.at % 32 - width
        self.at += width
        return value & (1 << width) - 1


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = 0
    while at < len(b):
        n = n << 7 | b[at] & 127
        at += 1
        if not b[at - 1] & 128:
            return n, at
    raise ContentError("Musepack", "a size ends early")


def _packets(b: bytes, at: int, out: Events) -> None:
    audio = 0
    while at + 3 <= len(b):
        key = b[at : at + 2]
        size, body = _varint(b, at + 2)
        end = at + size
        if key == b"SH":
            samples, p = _varint(b, body + 5)
            _, p = _varint(b, p)
            rate = _MPC_RATES[b[p] >> 5 & 3]
            out.format(container="Musepack, SV8", codec="Musepack SV8", sampleRate=rate, numberOfChannels=(b[p + 1] >> 4) + 1, numberOfSamples=samples, duration=samples / rate, hasAudio=True, lossless=False)
        elif key == b"AP":
            audio += end - body
        elif key == b"SE":
            break
        if end <= at:
            break
        at = end
    if out.known.get("duration") and audio:
        out.format(bitrate=float(round_half_up(audio * 8 / out.known["duration"])))
