"""Chunked files: WAVE, AIFF, DSDIFF and DSF."""

from __future__ import annotations

from tagloom.sources.decode.events import ContentError, Events, unpack, with_ends
from tagloom.sources.decode.id3 import id3v2
from tagloom.sources.fixed_layout import WAVE_CODECS

# AIFF-C compression names.
_AIFC = {"NONE": "not compressed PCM Apple Computer", "sowt": "PCM (byte swapped)", "fl32": "32-bit floating point IEEE 32-bit float", "fl64": "64-bit floating point IEEE 64-bit float", "alaw": "ALaw 2:1", "ulaw": "µLaw 2:1", "ULAW": "CCITT G.711 u-law", "ALAW": "CCITT G.711 A-law", "FL32": "Float 32"}


def chunks(b: bytes, at: int, end: int, order: str, out: Events, wide: bool = False):
    """(id, payload) of the chunks in [at, end); odd sizes are padded, sizes beyond the end are cut with a warning."""
    head = 12 if wide else 8
    while at + head <= end:
        ident = b[at : at + 4].decode("latin-1")
        (size,) = unpack(order + ("Q" if wide else "I"), b, at + 4)
        if at + head + size > end:
            out.warn(f"chunk {ident} is larger than what is left")
            size = end - at - head
        yield ident, at + head, size
        at += head + size + size % 2


def wave(b: bytes, out: Events) -> None:
    if b[:4] != b"RIFF" or b[8:12] != b"WAVE":
        raise ContentError("Wave", "RIFF/WAVE is missing")
    out.format(container="WAVE", hasAudio=True)
    fmt: tuple = ()
    samples = data_size = None
    cues: dict[int, int] = {}
    labels: dict[int, str] = {}
    lengths: dict[int, int] = {}
    for ident, at, size in chunks(b, 12, len(b), "<", out):
        p = b[at : at + size] if ident != "data" else b""
        if ident == "fmt ":
            if size < 16:
                raise ContentError("Wave", "the fmt chunk is too short")
            fmt = unpack("<HHIIHH", p)
            out.format(codec=WAVE_CODECS.get(fmt[0], f"non-PCM ({fmt[0]})"), numberOfChannels=fmt[1], sampleRate=fmt[2], bitsPerSample=fmt[5], bitrate=float(352000 if fmt[0] == 2 else fmt[4] * fmt[2] * 8), lossless=fmt[0] in (1, 3))
        elif ident == "fact":
            (samples,) = unpack("<I", p)
        elif ident == "data":
            data_size = size
        elif ident == "LIST":
            kind = p[:4]
            for sub, a, n in chunks(p, 4, len(p), "<", out):
                v = p[a : a + n]
                if kind == b"INFO":
                    out.tag("exif", sub, v.decode("utf-8", "replace").rstrip("\x00"))
                elif sub == "labl" and n >= 4:
                    labels[unpack("<I", v)[0]] = v[4:].decode("utf-8", "replace").rstrip("\x00")
                elif sub == "ltxt" and n >= 8:
                    ref, length = unpack("<II", v)
                    lengths[ref] = length
        elif ident == "cue ":
            for i in range(unpack("<I", p)[0]):
                if 4 + 24 * (i + 1) <= len(p):
                    ident_, _, _, _, _, offset = unpack("<IIIIII", p, 4 + 24 * i)
                    cues[ident_] = offset
        elif ident in ("ID3 ", "id3 "):
            id3v2(p, 0, out)
        elif ident not in ("bext", "PAD ", "JUNK", "FLLR", "PEAK"):
            out.warn(f"ignored chunk {ident}")
    if fmt and data_size is not None:
        n = samples if samples is not None else data_size // fmt[4] if fmt[4] else None
        if n is not None and fmt[2]:
            out.format(numberOfSamples=n, duration=n / fmt[2])
    rate = fmt[2] if fmt else 0
    if cues and rate:
        ms = lambda s: int(s * 1000 / rate + 0.5)
        found = []
        for n, (ref, offset) in enumerate(sorted(cues.items(), key=lambda c: c[1]), 1):
            c = {"id": str(ref), "title": labels.get(ref, f"Cue {n}"), "start": ms(offset), "sample_offset": offset}
            if ref in lengths:
                c["end"] = ms(offset + lengths[ref])
            found.append(c)
        out.chapters(with_ends(found, None))


def aiff(b: bytes, out: Events) -> None:
    kind = b[8:12]
    if b[:4] != b"FORM" or kind not in (b"AIFF", b"AIFC"):
        raise ContentError("AIFF", "FORM/AIFF is missing")
    out.format(container=kind.decode(), hasAudio=True, lossless=kind == b"AIFF")
    for ident, at, size in chunks(b, 12, len(b), ">", out):
        p = b[at : at + size] if ident != "SSND" else b""
        if ident == "COMM":
            if size < 18:
                raise ContentError("AIFF", "the COMM chunk is too short")
            channels, frames, bits, exponent, mantissa = unpack(">HIHHH", p)
            shift = exponent - 16398
            rate = mantissa >> -shift if shift < 0 else mantissa << shift
            codec = "PCM"
            if kind == b"AIFC":
                code = p[18:22].decode("latin-1")
                name = p[23 : 23 + p[22]].decode("latin-1").strip("\x00") if len(p) > 22 else ""
                codec = name or _AIFC.get(code, code)
            out.format(codec=codec, numberOfChannels=channels, bitsPerSample=bits, sampleRate=rate, numberOfSamples=frames, duration=frames / rate if rate else None)
        elif ident == "SSND" and out.known.get("duration"):
            out.format(bitrate=8 * size / out.known["duration"])
        elif ident in ("NAME", "AUTH", "(c) ", "ANNO"):
            for v in p.decode("utf-8", "replace").split("\x00"):
                if v.strip():
                    out.tag("AIFF", ident, v.strip())
        elif ident == "ID3 ":
            id3v2(p, 0, out)


def _comments(p: bytes) -> list[str]:
    """Texts of a COMT chunk: time, type and reference in ten bytes, the size in four, the text, padded to an even size."""
    found, at = [], 2
    for _ in range(unpack(">H", p)[0]):
        if at + 14 > len(p):
            break
        (size,) = unpack(">I", p, at + 10)
        text = p[at + 14 : at + 14 + size].decode("utf-8", "replace").strip("\x00 ")
        if text:
            found.append(text)
        at += 14 + size + size % 2
    return found


def dsdiff(b: bytes, out: Events) -> None:
    if b[:4] != b"FRM8" or b[12:16] != b"DSD ":
        raise ContentError("DSDIFF", "FRM8/DSD is missing")
    out.format(container="DSDIFF/DSD", codec="DSD", lossless=True, hasAudio=True)
    for ident, at, size in chunks(b, 16, len(b), ">", out, wide=True):
        p = b[at : at + size] if ident != "DSD " else b""
        if ident == "PROP" and p[:4] == b"SND ":
            for sub, a, n in chunks(p, 4, len(p), ">", out, wide=True):
                v = p[a : a + n]
                if sub == "FS  ":
                    out.format(sampleRate=unpack(">I", v)[0])
                elif sub == "CHNL":
                    out.format(numberOfChannels=unpack(">H", v)[0])
                elif sub == "CMPR":
                    code, name = v[:4].decode("latin-1").rstrip(), v[5 : 5 + v[4]].decode("latin-1")
                    out.format(codec=f"{code} ({name})" if name else code, lossless=True if code == "DSD" else None)
                elif sub in ("ABSS", "LSCO"):
                    continue  # start time and loudspeaker set-up tell nothing about the record
        elif ident == "DSD ":
            channels, rate = out.known.get("numberOfChannels") or 1, out.known.get("sampleRate")
            n = size * 8 // channels
            out.format(numberOfSamples=n, bitsPerSample=1, duration=n / rate if rate else None, bitrate=float(channels * rate) if rate else None)
        elif ident == "COMT":
            out.tag("DSDIFF", "COMT", _comments(p) or None)
        elif ident == "ID3 ":
            id3v2(p, 0, out)


def dsf(b: bytes, out: Events) -> None:
    if b[:4] != b"DSD ":
        raise ContentError("DSF", "the DSD mark is missing")
    size, _, pointer = unpack("<QQQ", b, 4)
    at = size
    if b[at : at + 4] != b"fmt ":
        raise ContentError("DSF", "the fmt chunk is missing")
    _, _, _, channels, rate, bits, samples = unpack("<IIIIIIQ", b, at + 12)
    out.format(container="DSF", codec="DSD", lossless=True, hasAudio=True, numberOfChannels=channels, sampleRate=rate, bitsPerSample=bits, numberOfSamples=samples, duration=samples / rate if rate else None, bitrate=float(bits * rate * channels))
    if pointer:
        id3v2(b, pointer, out)
