"""Reading by ranges: every strategy gives the rows of a full read, over files and over a web server."""

import http.server
import struct
import threading

import builders as B
import pytest

from tagloom import catalog
from tagloom.sources import audio as A
from tagloom.sources import ranges as R
from tagloom.sources.decode import ape, ebml
from tagloom.sources.decode.events import PRESETS

LIMITS = R.Limits(small=2048, large=20_000, head=2048, tail=4096, chunk=512)


def big_wav() -> bytes:
    fmt = struct.pack("<HHIIHH", 1, 2, 44100, 176400, 4, 16)
    body = b"WAVE" + B.chunk(b"fmt ", fmt) + B.chunk(b"LIST", b"INFO" + B.chunk(b"INAM", b"Song\0")) + B.chunk(b"data", b"\0" * 40000) + B.chunk(b"LIST", b"INFO" + B.chunk(b"IART", b"Late\0"))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def big_ogg() -> bytes:
    short = B.vorbis(["TITLE=Long"])
    return short[: short.rindex(b"OggS")] + b"".join(B.ogg_page(1, 4 * (g == 200), g * 44100, [bytes(1000)]) for g in range(1, 201))


def big_matroska(seek: bool, unknown: bool = False) -> bytes:
    head = B.matroska()
    at = head.index(bytes.fromhex("18538067"))
    body = head[at + 8 :]
    cut = body.index(bytes.fromhex("1254C367"))
    size = b"\x01\xff\xff\xff\xff\xff\xff\xff" if unknown else (0x10000000 | 30000).to_bytes(4, "big")
    cluster = bytes.fromhex("1F43B675") + size + bytes(30000)
    table = lambda pos: B.ebml("114D9B74", B.ebml("4DBB", B.ebml("53AB", bytes.fromhex("1254C367")) + B.ebml("53AC", pos.to_bytes(4, "big"))))
    front = len(table(0)) if seek else 0
    inner = (table(front + cut + len(cluster)) if seek else b"") + body[:cut] + cluster + body[cut:]
    return head[:at] + B.ebml("18538067", inner)


def sv7() -> bytes:
    bits = f"{115:08b}" + "".join(f"{n:020b}" + "1" * n for n in (37, 5, 64)) + f"{900:011b}"
    bits += "0" * (-len(bits) % 32)
    words = b"".join(struct.pack("<I", int(bits[i : i + 32], 2)) for i in range(0, len(bits), 32))
    return b"MP+\x07" + struct.pack("<II", 3, 0) + b"\0" * 8 + struct.pack("<I", 900 << 20) + words


FILES = {
    "wav": big_wav(), "ogg": big_ogg(), "flac": B.flac(["TITLE=S"]) + b"\0" * 30000, "aiff": B.aiff(), "apev2": B.monkeys([("Title", b"T", 0)]), "mp4": B.mp4() + B.atom(b"free", b"\0" * 30000), "asf": B.asf(), "mpeg": B.id3v2([("TIT2", b"\x03T")]) + B.mpeg_frames(80) + B.id3v1(),
    "wavpack": B.wavpack(), "dsf": B.dsf(), "dsdiff": B.dsdiff(), "musepack": B.musepack8() + b"\0" * 3000, "matroska": big_matroska(True),
}


@pytest.mark.parametrize("loader", list(FILES))
@pytest.mark.parametrize("preset", ["all", "metadata_only"])
def test_every_strategy_gives_the_same_rows(loader, preset):
    content = FILES[loader]
    want = A.decode_bytes(content, loader, PRESETS[preset])
    assert any(r[1] == "format" for r in want) and not any(r[1] == "error" for r in want)
    for strategy in R.STRATEGIES:
        for cat in ("header-only", "mpeg", "mp4", "unknown"):
            got, used, reason, fetched = R.open_object(R.bytes_object(content), strategy, cat, LIMITS)
            assert A.decode_bytes(got, loader, PRESETS[preset]) == want, (strategy, cat)
            assert fetched.bytes <= len(content) and fetched.requests >= 1


def test_only_what_is_needed_is_fetched():
    for loader in ("wav", "ogg", "flac", "mp4", "matroska"):
        got, _, _, fetched = R.open_object(R.bytes_object(FILES[loader]), "headerOnly", "header-only", LIMITS)
        rows = A.decode_bytes(got, loader, PRESETS["metadata_only"])
        assert rows and fetched.bytes < len(FILES[loader]) / 2, loader


def test_seek_table_leads_over_clusters():
    want = [r[1:] for r in A.decode_bytes(big_matroska(True), "matroska", PRESETS["all"]) if r[1] == "tag"]
    assert [r[1:] for r in A.decode_bytes(big_matroska(True, unknown=True), "matroska", PRESETS["all"]) if r[1] == "tag"] == want and want
    assert not [r for r in A.decode_bytes(big_matroska(False, unknown=True), "matroska", PRESETS["all"]) if r[1] == "tag" and "ARTIST" in r[3]]
    assert ebml.next_seek({"SeekHead": [{"Seek": [{"SeekPosition": [9]}, {"SeekPosition": [5]}, {"SeekPosition": [2]}]}]}, 10, 12) == 15
    assert ebml._number(bytes.fromhex("400EAC44000000000000")) == 44100.0


def test_bits_and_musepack_7():
    b = struct.pack("<II", 0x89ABCDEF, 0x01234567)
    r = ape.Bits(b, 0)
    assert [r.read(n) for n in (4, 8, 24, 28)] == [0x8, 0x9A, 0xBCDEF0, 0x1234567]
    rows = {x[3]: x for x in A.decode_bytes(sv7(), "musepack", PRESETS["all"]) if x[1] == "format"}
    samples = 1152 * 2 + 900
    assert rows["codec"][4] == "1.15" and rows["numberOfSamples"][5] == samples
    assert rows["bitrate"][6] == round((60 + 37 + 5 + 64 + 900) / (samples / 44100))


def test_retries_and_statuses():
    calls = []

    def flaky(lo, hi):
        calls.append((lo, hi))
        if len(calls) < 3:
            raise OSError("lost")
        return bytes(hi - lo)

    r = R.RangeReader(R.Remote(100, True, None, flaky), chunk=64, back_off_ms=1)
    assert r[:10] == bytes(10) and r.fetched.retries == 2 and calls == [(0, 64)] * 3

    def gone(lo, hi):
        calls.append(0)
        raise R.Gone("404")

    calls.clear()
    with pytest.raises(OSError):
        R.RangeReader(R.Remote(100, True, None, gone), chunk=64, back_off_ms=1)[0]
    assert len(calls) == 1


@pytest.fixture()
def server():
    state = {"ranges": True, "lose": 0, "seen": []}

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_HEAD(self):
            self.answer(False)

        def do_GET(self):
            self.answer(True)

        def answer(self, body):
            content = FILES.get(self.path.partition("?")[0].rpartition(".")[2])
            if content is None:
                self.send_error(404)
                return
            asked = self.headers.get("Range")
            state["seen"].append(asked)
            if body and state["lose"]:
                state["lose"] -= 1
                self.close_connection = True
                self.connection.close()
                return
            if asked and state["ranges"]:
                lo, hi = map(int, asked.removeprefix("bytes=").split("-"))
                part = content[lo : hi + 1]
                self.send_response(206)
            else:
                part = content
                self.send_response(200)
            self.send_header("Content-Length", str(len(part)))
            if state["ranges"]:
                self.send_header("Accept-Ranges", "bytes")
            self.end_headers()
            if body:
                self.wfile.write(part)

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", state
    s.shutdown()


def test_reading_by_url(spark, server):
    at, state = server
    urls = spark.createDataFrame([(1, f"{at}/a.wav", None), (2, f"{at}/b.flac?x=1", None), (3, f"{at}/c.none", "audio/flac"), (4, None, "audio/flac"), (5, "odd://x/y.flac", None)], "file_id long, url string, mime_type string")
    for ranges, strategy in ((True, "auto"), (True, "probe"), (False, "auto")):
        state.update(ranges=ranges, lose=2 if strategy == "probe" else 0)
        rows = R.read_urls(urls, "metadata_only", strategy, LIMITS).collect()
        done = {r["file_id"]: r for r in rows if r["kind"] == "fetch"}
        assert {r["file_id"] for r in rows if r["kind"] == "error"} == {3, 4, 5}
        for i, name in ((1, "wav"), (2, "flac")):
            want = A.decode_bytes(FILES[name], name, PRESETS["metadata_only"])
            assert [(r["kind"], r["tag_id"], r["v_str"], r["v_dbl"]) for r in sorted((r for r in rows if r["file_id"] == i and r["kind"] != "fetch"), key=lambda r: r["seq"])] == [(w[1], w[3], w[4], w[6]) for w in want]
            assert done[i]["strategy"] == ("fullDownload" if not ranges else "headerOnly" if strategy == "auto" else "probe")
            assert ranges == (done[i]["bytes_fetched"] < len(FILES[name])) and done[i]["size"] == len(FILES[name])


def test_registered_decoders_and_providers_reach_the_workers(spark):
    def decode(b, out):
        out.format(container="Own", duration=float(len(b)))
        out.tag("own", "X", bytes(b[:4]).decode())

    A.register("own", decode, extensions=("own",))
    R.register_provider("mem", lambda url: R.bytes_object(b"abcdef"))
    catalog.register_mapper("own", {"x": "title"})
    try:
        from tagloom.operators import resolve

        rows = R.read_urls(spark.createDataFrame([(1, "mem://f/a.own", None)], "file_id long, url string, mime_type string"))
        assert [r["v_str"] for r in rows.where("kind = 'tag'").collect()] == ["abcd"]
        mapped = resolve.map_tags(resolve.tag_values(A.tag_events(rows)))
        assert "title" in str(mapped.collect())
        assert [r["v_dbl"] for r in A.decode_files(spark.createDataFrame([(1, "own", b"xy")], "file_id long, loader string, content binary")).where("tag_id = 'duration'").collect()] == [2.0]
    finally:
        A.DECODERS.pop("own")
        R.PROVIDERS.pop("mem")
        catalog.clear_registered()
