"""Reading of remote or large objects by byte ranges: strategy, chunk cache, retries, statistics.

A decoder takes a ``RangeReader`` for bytes: it has the true size, gives slices,
and fetches the chunks it is asked for, so every strategy ends with the same
result and differs only in what it fetches and when. Byte providers are
registered by URL scheme and travel with the tasks.
"""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.strategy import BACK_OFF_MS, CATEGORIES, CHUNK, HEAD, LARGE_FILE, PARALLEL, PROBES, SMALL_FILE, TAIL, TRIES, category, dispatch
from tagloom.sources import audio
from tagloom.sources.decode.events import PRESETS, Options

#: Chunks a reader keeps; the least recently used one goes first, so a large object never fills the memory.
KEPT = 1024
TIMEOUT = 30.0
STRATEGIES = ("auto", "fullDownload", "headerOnly", "probe", "randomAccess")


@dataclass
class Remote:
    """An object behind a URL: its size (None where unknown), whether ranges can be read, its MIME type, and how to read them."""

    size: int | None
    ranges: bool
    mime: str | None
    read: Callable[[int, int | None], bytes]


class Gone(OSError):
    """The server answers with an error status; trying again doesn't help."""


def http_object(url: str, timeout: float = TIMEOUT) -> Remote:
    """An object of a web server. A HEAD request tells size and ranges; without an answer to it the size is unknown."""
    size, ranges, mime = None, False, None
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:
            length = r.headers.get("Content-Length")
            size, ranges, mime = int(length) if length else None, r.headers.get("Accept-Ranges", "").lower() == "bytes", r.headers.get("Content-Type")
    except (OSError, ValueError):
        pass

    def read(lo: int, hi: int | None) -> bytes:
        try:
            asked = urllib.request.Request(url, headers={} if hi is None else {"Range": f"bytes={lo}-{hi - 1}"})
            with urllib.request.urlopen(asked, timeout=timeout) as r:
                data = r.read()
                # a server that doesn't know ranges sends everything
                return data if hi is None or r.status == 206 else data[lo:hi]
        except urllib.error.HTTPError as e:
            raise Gone(f"{url}: status {e.code}") from None

    return Remote(size, ranges, mime, read)


def local_object(url: str) -> Remote:
    path = url.removeprefix("file://")

    def read(lo: int, hi: int | None) -> bytes:
        with open(path, "rb") as f:
            f.seek(lo)
            return f.read() if hi is None else f.read(hi - lo)

    return Remote(os.path.getsize(path), True, None, read)


def bytes_object(content: bytes) -> Remote:
    return Remote(len(content), True, None, lambda lo, hi: content[lo:hi])


#: Provider of each URL scheme; '' stands for a path.
PROVIDERS: dict[str, Callable[[str], Remote]] = {"http": http_object, "https": http_object, "file": local_object, "": local_object}


def register_provider(scheme: str, provider: Callable[[str], Remote]) -> None:
    """Objects of a scheme come from ``provider``; it is sent to the workers with each read."""
    PROVIDERS[scheme] = provider


@dataclass
class Fetched:
    """What a reader fetched."""

    requests: int = 0
    bytes: int = 0
    retries: int = 0
    chunks: set[int] = field(default_factory=set)


class RangeReader:
    """Bytes of an object, fetched by chunks when they are asked for. Slices, single bytes, ``find`` and ``len`` work as those of ``bytes``."""

    sparse = True

    def __init__(self, remote: Remote, chunk: int = CHUNK, tries: int = TRIES, back_off_ms: int = BACK_OFF_MS) -> None:
        if remote.size is None:
            raise ValueError("the size of the object is unknown")
        self.remote, self.size, self.chunk, self.tries, self.back_off_ms = remote, remote.size, chunk, tries, back_off_ms
        self.cache: OrderedDict[int, bytes] = OrderedDict()
        self.fetched = Fetched()

    def __len__(self) -> int:
        return self.size

    def request(self, lo: int, hi: int) -> bytes:
        """One ranged request; lost connections are tried again after a growing wait, error statuses are not."""
        for attempt in range(1, self.tries + 1):
            try:
                data = self.remote.read(lo, hi)
                if len(data) != hi - lo:
                    raise OSError(f"{len(data)} bytes instead of {hi - lo}")
                return data
            except Gone:
                raise
            except OSError:
                if attempt == self.tries:
                    raise
                self.fetched.retries += 1
                time.sleep(self.back_off_ms * attempt / 1000)
        raise AssertionError

    def prefetch(self, ranges: list[tuple[int, int]]) -> None:
        """Fetches the missing chunks of the ranges; neighbouring chunks are one request, a few requests run side by side."""
        need = sorted({c for lo, hi in ranges if hi > lo for c in range(lo // self.chunk, (min(hi, self.size) - 1) // self.chunk + 1)} - self.cache.keys())
        islands: list[list[int]] = []
        for c in need:
            if islands and islands[-1][-1] + 1 == c:
                islands[-1].append(c)
            else:
                islands.append([c])
        bounds = [(i[0] * self.chunk, min((i[-1] + 1) * self.chunk, self.size)) for i in islands]
        if len(bounds) > 1:
            with ThreadPoolExecutor(PARALLEL) as pool:
                parts = list(pool.map(lambda b: self.request(*b), bounds))
        else:
            parts = [self.request(*b) for b in bounds]
        for (lo, hi), data in zip(bounds, parts):
            self.fetched.requests += 1
            self.fetched.bytes += hi - lo
            for at in range(lo, hi, self.chunk):
                self.cache[at // self.chunk] = data[at - lo : at - lo + self.chunk]
                self.fetched.chunks.add(at // self.chunk)

    def _read(self, lo: int, hi: int) -> bytes:
        if hi <= lo:
            return b""
        first, last = lo // self.chunk, (hi - 1) // self.chunk
        if any(c not in self.cache for c in range(first, last + 1)):
            self.prefetch([(lo, hi)])
        parts = []
        for c in range(first, last + 1):
            self.cache.move_to_end(c)
            parts.append(self.cache[c])
        data = parts[0] if len(parts) == 1 else b"".join(parts)
        while len(self.cache) > KEPT:
            self.cache.popitem(last=False)
        return data[lo - first * self.chunk : hi - first * self.chunk]

    def __getitem__(self, at):
        if isinstance(at, slice):
            lo, hi, step = at.indices(self.size)
            if step < 0:
                return self._read(hi + 1, lo + 1)[::step]
            return self._read(lo, hi)[::step]
        at = at + self.size if at < 0 else at
        if not 0 <= at < self.size:
            raise IndexError(at)
        return self._read(at, at + 1)[0]

    def find(self, part: bytes, lo: int = 0, hi: int | None = None) -> int:
        hi = self.size if hi is None else min(hi, self.size)
        while lo < hi:
            # a hit may lie across the end of a chunk
            to = min((lo // self.chunk + 1) * self.chunk, hi)
            at = self._read(lo, min(to + len(part) - 1, hi)).find(part)
            if at >= 0:
                return lo + at
            lo = to
        return -1

    def __bytes__(self) -> bytes:
        return self._read(0, self.size)


@dataclass(frozen=True)
class Limits:
    """Sizes the choice of a strategy depends on."""

    small: int = SMALL_FILE
    large: int = LARGE_FILE
    head: int = HEAD
    tail: int = TAIL
    chunk: int = CHUNK


def choose(size: int | None, ranges: bool, cat: str, limits: Limits = Limits()) -> tuple[str, str]:
    """(strategy, reason) of an object."""
    if size is None:
        return "fullDownload", "size unknown"
    if size <= limits.small:
        return "fullDownload", "small file"
    if not ranges:
        return "fullDownload", "no ranges"
    if cat == "header-only":
        return "headerOnly", "header format"
    return ("randomAccess", "large file") if size > limits.large else ("probe", "medium file")


def _down(pos: int, chunk: int) -> int:
    return pos // chunk * chunk


def first_ranges(strategy: str, cat: str, size: int, limits: Limits = Limits()) -> list[tuple[int, int]]:
    """Ranges a strategy fetches before decoding; the rest comes when it is asked for."""
    c, head = limits.chunk, (0, min(limits.head, size))
    tail = (_down(max(0, size - c), c), size)
    if strategy == "headerOnly":
        return [head]
    if strategy == "randomAccess":
        return [head, (_down(max(0, size - limits.tail), c), size)]
    if strategy == "probe":
        kind = PROBES[cat]
        if kind == "mp4Optimized":
            return [head, (_down(max(0, size - limits.tail), c), size), *[(at, min(at + c, size)) for q in (1, 2, 3) for at in [_down(size * q // 4, c)]]]
        return [head, tail] if kind == "headerAndTail" else [head, tail, (_down(size // 2, c), min(_down(size // 2, c) + c, size))]
    return [(0, size)]


def open_object(remote: Remote, strategy: str, cat: str, limits: Limits = Limits()) -> tuple[bytes | RangeReader, str, str, Fetched]:
    """(bytes or reader, strategy, reason, what was fetched so far)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    chosen, reason = choose(remote.size, remote.ranges, cat, limits) if strategy == "auto" else (strategy, "asked for")
    if remote.size is None or not remote.ranges:
        content = remote.read(0, None)
        return content, "fullDownload", reason if chosen == "fullDownload" else "no ranges", Fetched(1, len(content))
    reader = RangeReader(remote, limits.chunk)
    reader.prefetch(first_ranges(chosen, cat, remote.size, limits))
    return (bytes(reader), chosen, reason, reader.fetched) if chosen == "fullDownload" else (reader, chosen, reason, reader.fetched)


_EXTRA = "strategy string, reason string, size long, requests int, bytes_fetched long, retries int, chunks int"


def _rows(todo: Iterator[tuple], options: Options, strategy: str, limits: Limits, decoders: dict) -> Iterator[tuple]:
    """Event rows of (file_id, loader, category, open); the last row of a file has kind 'fetch' and what was fetched."""
    for file_id, loader, cat, opened in todo:
        used, reason, size, got, n = None, None, None, Fetched(), 0
        try:
            remote = opened()
            content, used, reason, got = open_object(remote, strategy, cat, limits)
            size = len(content)
            for row in audio.decode_bytes(content, loader, options, decoders):
                n += 1
                yield (file_id, *row, *[None] * 7)
        except (OSError, ValueError) as e:
            yield (file_id, n, "error", None, "TokenizerError", f"{type(e).__name__}: {e}", *[None] * 13)
            n += 1
        f = asdict(got) | {"chunks": len(got.chunks)}
        yield (file_id, n, "fetch", *[None] * 9, used, reason, size, f["requests"], f["bytes"], f["retries"], f["chunks"])


_TYPES = [*audio._TYPES, pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
SCHEMA = f"{audio.SCHEMA}, {_EXTRA}"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], _NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], _NAMES)


def read_urls(urls: DataFrame, options: Options | str = "metadata_only", strategy: str = "auto", limits: Limits = Limits()) -> DataFrame:
    """Event rows of the objects of (file_id, url, mime_type), and one 'fetch' row of each with strategy, reason and bytes.

    Every strategy gives the same events. An object that can't be read is an error row; a null URL is one too.
    """
    opts, providers, decoders = PRESETS[options] if isinstance(options, str) else options, dict(PROVIDERS), dict(audio.DECODERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opener(url: str | None) -> Callable[[], Remote]:
            def opened() -> Remote:
                if url is None:
                    raise ValueError("there is no URL")
                scheme = url.partition("://")[0] if "://" in url else ""
                if scheme not in providers:
                    raise ValueError(f"no provider for {scheme}")
                return providers[scheme](url)

            return opened

        todo = ((i, loader, cat, opener(u)) for b in batches for i, u, loader, cat in zip(*[c.to_pylist() for c in b.columns]))
        yield from _batches(_rows(todo, opts, strategy, limits, decoders))

    found = dispatch(urls.select(F.col("file_id").cast("long").alias("file_id"), "url", "mime_type", F.regexp_replace("url", r"[?#].*$", "").alias("_p")), "_p", "mime_type")
    return found.select("file_id", "url", "loader", category(F.col("url"), F.col("mime_type")).alias("cat")).mapInArrow(run, SCHEMA)


def read_contents(files: DataFrame, options: Options | str = "metadata_only", strategy: str = "auto", limits: Limits = Limits()) -> DataFrame:
    """The same for (file_id, loader, content): the bytes of a column are read by ranges."""
    opts, decoders = PRESETS[options] if isinstance(options, str) else options, dict(audio.DECODERS)
    cats = {loader: next((c for c, (ext, _) in CATEGORIES.items() if loader in ext.split()), "header-only") for loader in decoders}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = ((i, loader, cats.get(loader, "unknown"), lambda c=content: bytes_object(c or b"")) for b in batches for i, loader, content in zip(*[x.to_pylist() for x in b.columns]))
        yield from _batches(_rows(todo, opts, strategy, limits, decoders))

    return files.select(F.col("file_id").cast("long"), "loader", "content").mapInArrow(run, SCHEMA)
