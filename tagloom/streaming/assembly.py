"""Streams of byte chunks: assembly per stream, decoding at its end, change events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagloom.sources.audio import decode_bytes
from tagloom.sources.decode.events import PRESETS, SCHEMA

_OUT = SCHEMA.replace("file_id long", "stream_id long")
_STATE = "loader string, chunk_nos array<int>, chunks array<binary>, last_no int"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def decode_stream(chunks: DataFrame, preset: str = "metadata_only", timeout_ms: int | None = None) -> DataFrame:
    """Event rows of streams (stream_id, chunk_no, is_last, data, loader), appended when a stream is complete.

    Chunks may arrive in any order and more than once. A stream is complete when
    all chunks up to the one marked last are there; with ``timeout_ms`` set, what
    has arrived is decoded after that time without a chunk. Only loaders that need no seek should
    be fed from live streams; the whole stream is held in state until then.
    """
    options = PRESETS[preset]

    def rows(key: int, loader: str | None, parts: dict[int, bytes]) -> pd.DataFrame:
        found = decode_bytes(b"".join(parts[n] for n in sorted(parts)), loader, options)
        return pd.DataFrame([(key, *r) for r in found], columns=_NAMES).astype(object)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        loader, nos, data, last = state.get if state.exists else (None, [], [], None)
        parts = dict(zip(nos, data))
        if state.hasTimedOut:
            state.remove()
            yield rows(int(key[0]), loader, parts)
            return
        for f in frames:
            for no, is_last, chunk, name in zip(f["chunk_no"], f["is_last"], f["data"], f["loader"]):
                parts.setdefault(int(no), bytes(chunk))
                last = int(no) if is_last else last
                loader = loader or name
        if last is not None and all(n in parts for n in range(last + 1)):
            if state.exists:
                state.remove()
            yield rows(int(key[0]), loader, parts)
        else:
            state.update((loader, sorted(parts), [parts[n] for n in sorted(parts)], last))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)

    return chunks.groupBy("stream_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def watch_files(spark, path: str) -> DataFrame:
    """New audio files of a folder as a stream of (path, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).select("path", "length", "content")
