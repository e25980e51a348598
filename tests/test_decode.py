import pytest

import builders as B
from tagloom.sources.audio import decode_bytes
from tagloom.sources.decode.events import PRESETS, Options

ALL = PRESETS["all"]


def read(content, loader, options=ALL):
    fmt, tags, chapters, kinds = {}, {}, [], []
    for seq, kind, fid, tid, s, i, d, b, raw, lst, js in decode_bytes(content, loader, options):
        value = next((x for x in (s, i, d, b, raw, lst) if x is not None), None)
        kinds.append(kind)
        if kind == "format":
            fmt[tid] = value
        elif kind == "tag":
            tags[fid, tid] = value
        elif kind == "chapter":
            import json

            chapters.append(json.loads(js))
    return fmt, tags, chapters, kinds


def test_id3v2_frames_and_chapters():
    chap = b"c1\0" + (0).to_bytes(4, "big") + (1000).to_bytes(4, "big") + b"\xff" * 8 + B.id3v2([("TIT2", b"\x03One")])[10:]
    chap2 = b"c2\0" + (1000).to_bytes(4, "big") + (2000).to_bytes(4, "big") + b"\xff" * 8
    toc = b"toc\0\x03\x03c2\0c9\0c1\0"
    frames = [("TIT2", b"\x01\xff\xfe" + "é/x".encode("utf-16-le")), ("TPE1", b"\x03A\0B"), ("TXXX", b"\x03K\0V"), ("COMM", b"\x00engd\0text"), ("CHAP", chap), ("CHAP", chap2), ("CTOC", toc), ("APIC", b"\x00image/jpg\0\x03d\0\xff\xd8\xff")]
    fmt, tags, chapters, kinds = read(B.id3v2(frames) + B.mpeg_frames() + B.id3v1(), "mpeg")
    assert tags["ID3v2.4", "TIT2"] == "é/x" and tags["ID3v2.4", "TPE1"] == ["A", "B"]
    assert tags["ID3v2.4", "TXXX:K"] == "V" and tags["ID3v2.4", "COMM"] == "text"
    assert [c["title"] for c in chapters] == ["Chapter", "One"] and "picture" in kinds
    assert tags["ID3v1", "genre"] == "Pop" and tags["ID3v1", "track"] == 5
    assert fmt["codec"] == "MPEG 1 Layer 3" and fmt["codecProfile"] == "CBR" and fmt["numberOfSamples"] == 11520 and fmt["sampleRate"] == 44100


def test_id3v23_splits_at_slash_and_options_prune():
    b = B.id3v2([("TPE1", b"\x00AC/DC"), ("APIC", b"\x00image/png\0\x03\0\x89PNG")], 3) + B.mpeg_frames()
    _, tags, _, kinds = read(b + B.id3v1(), "mpeg", Options(skip_covers=True, skip_post_headers=True))
    assert tags["ID3v2.3", "TPE1"] == ["AC", "DC"] and "picture" not in kinds and not any(k[0] == "ID3v1" for k in tags)


def test_flac():
    fmt, tags, chapters, _ = read(B.flac(["TITLE=Song", "tracknumber=7", "CHAPTER001=00:00:01.5", "CHAPTER001NAME=In"]), "flac")
    assert fmt["duration"] == 3.0 and fmt["sampleRate"] == 44100 and fmt["bitsPerSample"] == 16 and fmt["tool"] == "ven"
    assert tags["vorbis", "TITLE"] == "Song" and tags["vorbis", "TRACKNUMBER"] == "7"
    assert chapters[0]["start"] == 1500 and chapters[0]["title"] == "In"


def test_ogg_vorbis_and_opus():
    fmt, tags, _, _ = read(B.vorbis(["ARTIST=A" + "x" * 300]), "ogg")
    assert fmt["codec"] == "Vorbis I" and fmt["duration"] == 2.0 and tags["vorbis", "ARTIST"].startswith("Ax")
    fmt, tags, _, _ = read(B.opus(["TITLE=O"]), "ogg")
    assert fmt["codec"] == "Opus" and fmt["sampleRate"] == 48000 and fmt["duration"] == 1.0


def test_wav_and_aiff():
    fmt, tags, chapters, _ = read(B.wav(), "wav")
    assert fmt["codec"] == "PCM" and fmt["numberOfSamples"] == 1000 and fmt["bitrate"] == 32000.0 and tags["exif", "INAM"] == "Song"
    assert [(c["title"], c["start"], c.get("end")) for c in chapters] == [("Intro", 0, 500), ("Cue 2", 500, 750)]
    fmt, tags, _, _ = read(B.aiff(), "aiff")
    assert fmt["sampleRate"] == 8000 and fmt["numberOfSamples"] == 8000 and fmt["bitrate"] == 128064.0 and tags["AIFF", "NAME"] == "Song"


def test_ape_wavpack_musepack():
    fmt, tags, _, kinds = read(B.monkeys([("Title", b"T", 0), ("Artist", b"A\0B", 0), ("Cover Art (Front)", b"f.jpg\0\xff\xd8\xff", 1)]), "apev2")
    assert fmt["numberOfSamples"] == 2 * 73728 + 100 and tags["APEv2", "Artist"] == ["A", "B"] and "picture" in kinds
    fmt, *_ = read(B.wavpack(), "wavpack")
    assert fmt["codec"] == "PCM" and fmt["bitsPerSample"] == 16 and fmt["sampleRate"] == 44100 and fmt["duration"] == 1.0 and fmt["audioMD5"] == b"\x05" * 16
    fmt, *_ = read(B.musepack8(), "musepack")
    assert fmt["numberOfSamples"] == 24000 - 0 or fmt["sampleRate"] == 44100


def test_mp4():
    fmt, tags, chapters, kinds = read(B.mp4(), "mp4")
    assert fmt["container"] == "M4A/isom/mp42" and fmt["codec"] == "MPEG-4/AAC" and fmt["duration"] == 2.0
    assert tags["iTunes", "©nam"] == "Tïtle" and tags["iTunes", "trkn"] == "1/12" and tags["iTunes", "----:com.apple.iTunes:LABEL"] == "Lbl"
    assert [(c["title"], c["start"], c["end"]) for c in chapters] == [("Start", 0, 1990), ("Chapter 2", 1990, 2000)] and "picture" in kinds


def test_asf_matroska():
    fmt, tags, _, _ = read(B.asf(), "asf")
    assert fmt["duration"] == 2.0 and fmt["bitrate"] == 192639.0 and fmt["container"] == "ASF/audio" and tags["asf", "WM/TrackNumber"] == 9 and tags["asf", "Title"] == "Ttl"
    fmt, tags, chapters, _ = read(B.matroska(), "matroska")
    assert fmt["duration"] == 5.0 and fmt["codec"] == "OPUS" and fmt["sampleRate"] == 48000 and tags["matroska", "track:ARTIST"] == "Art"
    assert chapters[0]["title"] == "Intro" and chapters[0]["end"] == 5000


def test_dsd():
    fmt, tags, _, _ = read(B.dsf(), "dsf")
    assert fmt["bitrate"] == 11289600.0 and fmt["duration"] == 0.1 and tags["ID3v2.4", "TIT2"] == "Song"
    fmt, *_ = read(B.dsdiff(), "dsdiff")
    assert fmt["sampleRate"] == 2822400 and fmt["numberOfSamples"] == 4000 and fmt["bitrate"] == 5644800.0


LOADERS = ["flac", "mp4", "ogg", "wav", "aiff", "asf", "apev2", "matroska", "musepack", "wavpack", "dsf", "dsdiff", "mpeg"]


@pytest.mark.parametrize("loader", LOADERS)
@pytest.mark.parametrize("content", [None, b"", b"\0" * 300, b"RIFF", bytes(range(256))])
def test_damaged_bytes_become_rows(content, loader):
    rows = decode_bytes(content, loader)
    assert rows == [] or all(len(r) == 11 for r in rows)


@pytest.mark.parametrize("make,loader", [(B.mp4, "mp4"), (B.wav, "wav"), (B.asf, "asf"), (B.matroska, "matroska"), (lambda: B.flac(["A=b"]), "flac"), (lambda: B.vorbis(["A=b"]), "ogg")])
def test_cut_files_never_crash(make, loader):
    whole = make()
    for n in range(0, len(whole), 7):
        decode_bytes(whole[:n], loader, ALL)


def test_unknown_loader_is_an_error_row():
    assert decode_bytes(b"x", None)[0][3] == "CouldNotDetermineFileTypeError"


def test_lyrics3_and_chapter_pictures_and_dsdiff_comments():
    import struct

    block = b"LYRICSBEGIN" + b"IND00003110" + b"LYR00005Hello"
    mp3 = B.mpeg_frames() + block + f"{len(block):06d}".encode() + b"LYRICS200" + B.id3v1()
    rows = {r[3]: r[4] for r in decode_bytes(mp3, "lyrics3", PRESETS["all"]) if r[1] == "tag" and r[2] == "Lyrics3"}
    assert rows == {"IND": "110", "LYR": "Hello"}
    assert not [r for r in decode_bytes(mp3, "mpeg", PRESETS["all"]) if r[2] == "Lyrics3"]
    pic = b"\x00image/png\0\x03\0\x89PNG"
    chap = b"c1\0" + struct.pack(">IIII", 0, 1000, 0xFFFFFFFF, 0xFFFFFFFF) + b"APIC" + B.synchsafe(len(pic)) + b"\0\0" + pic
    assert [r[8] for r in decode_bytes(B.id3v2([("CHAP", chap)]), "id3v2", PRESETS["all"]) if r[1] == "picture"] == [b"\x89PNG"]
    c = lambda n, p: n + struct.pack(">Q", len(p)) + p + b"\0" * (len(p) % 2)
    prop = b"SND " + c(b"FS  ", struct.pack(">I", 2822400)) + c(b"CHNL", struct.pack(">H", 2)) + c(b"CMPR", b"DSD " + bytes([3]) + b"raw") + c(b"ABSS", struct.pack(">HBBI", 1, 2, 3, 4)) + c(b"LSCO", struct.pack(">H", 7))
    comt = struct.pack(">H", 1) + struct.pack(">HBBBBHH", 2020, 1, 1, 0, 0, 0, 0) + struct.pack(">I", 4) + b"Nice"
    body = b"DSD " + c(b"PROP", prop) + c(b"COMT", comt) + c(b"DSD ", bytes(100))
    rows = decode_bytes(b"FRM8" + struct.pack(">Q", len(body)) + body, "dsdiff", PRESETS["all"])
    assert [(r[3], r[9]) for r in rows if r[1] == "tag"] == [("COMT", ["Nice"])]
    assert [r[4] for r in rows if r[3] == "codec"][-1] == "DSD (raw)"
