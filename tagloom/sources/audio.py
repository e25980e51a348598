"""Audio bytes to event rows: batch scans, decoding, errors as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import catalog
from tagloom.operators.strategy import dispatch
from tagloom.sources.decode import ape, asf, ebml, events, id3, iff, mp4, mpeg, xiph
from tagloom.sources.decode.events import PRESETS, SCHEMA, ContentError, Events, Options

#: Decoder of each loader; more can be registered.
DECODERS: dict[str, Callable[[bytes, Events], None]] = {
    "flac": xiph.flac,
    "ogg": xiph.ogg,
    "mp4": mp4.mp4,
    "wav": iff.wave,
    "aiff": iff.aiff,
    "asf": asf.asf,
    "apev2": ape.monkeys_audio,
    "matroska": ebml.matroska,
    "musepack": lambda b, out: ebml.matroska(b, out) if b[:4] == b"\x1a\x45\xdf\xa3" else ape.musepack(b, out),
    "wavpack": ape.wavpack,
    "dsf": iff.dsf,
    "dsdiff": iff.dsdiff,
    "id3v2": lambda b, out: id3.id3v2(b, 0, out),
    "mpeg": mpeg.mpeg,
    "lyrics3": mpeg.lyrics3,
}


def register(loader: str, decode: Callable[[bytes, Events], None], extensions: tuple[str, ...] = (), mime_types: tuple[str, ...] = (), needs_seek: bool = False) -> None:
    """Adds or replaces a decoder, and the keys by which files find it; the last registration of a key wins.

    The decoders go to the workers with each read, so a function of a session's own works there too.
    """
    DECODERS[loader] = decode
    catalog.register_loader(loader, extensions, mime_types, needs_seek)


def decode_bytes(content, loader: str | None, options: Options = PRESETS["metadata_only"], decoders: dict | None = None) -> list[tuple]:
    """Event rows (seq, kind, ...) of one file; a failure becomes rows of kind 'error' behind what was read.

    ``content`` is bytes or a reader of ranges; null counts as empty.
    """
    decoders = DECODERS if decoders is None else decoders
    content = b"" if content is None else content
    out = Events(options, len(content))
    if loader not in decoders:
        out._add("error", None, "CouldNotDetermineFileTypeError", "no loader for this file")
        return out.rows
    try:
        decoders[loader](content, out)
    except ContentError as e:
        out._add("error", e.file_type, "UnexpectedFileContentError", str(e))
    except (IndexError, ValueError, KeyError, RecursionError) as e:
        out._add("error", loader, "FieldDecodingError", f"{type(e).__name__}: {e}")
    return out.rows


_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.string()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def decode_files(files: DataFrame, options: Options | str = "metadata_only", mode: str = "PERMISSIVE") -> DataFrame:
    """Event rows of (file_id, loader, content). Empty or null content gives an error row; FAILFAST raises instead."""
    opts, decoders = PRESETS[options] if isinstance(options, str) else options, dict(DECODERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file_id, loader, content in zip(*[b.column(i).to_pylist() for i in range(3)]):
                for r in decode_bytes(content, loader, opts, decoders):
                    if mode == "FAILFAST" and r[1] == "error":
                        raise ValueError(f"file {file_id}: {r[4]}")
                    rows.append((file_id, *r))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return files.select(F.col("file_id").cast("long"), "loader", "content").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def scan_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(file_id, file_path, mime_type, length, content) of a folder; a size limit is pushed to the scan."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        f = f.where(F.col("length") < max_bytes)
    return f.select(F.xxhash64("path").alias("file_id"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("mime_type"), "length", "content")


def read_audio(spark: SparkSession, path: str, options: Options | str = "metadata_only", mode: str = "PERMISSIVE", max_bytes: int | None = None) -> DataFrame:
    """Event rows of all audio files below ``path``."""
    return decode_files(dispatch(scan_files(spark, path, max_bytes)), options, mode)


def join_chunks(chunks: DataFrame) -> DataFrame:
    """(stream_id, content): byte streams put together from (stream_id, chunk_no, data); repeated chunks count once."""
    once = chunks.groupBy("stream_id", "chunk_no").agg(F.first("data", ignorenulls=True).alias("data"))
    whole = once.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "data"))).alias("c"))
    return whole.select("stream_id", F.aggregate(F.transform("c", lambda x: x["data"]), F.unhex(F.lit("")), lambda a, x: F.concat(a, x)).alias("content"))


def tag_events(decoded: DataFrame) -> DataFrame:
    """The tag rows as the resolve operators take them."""
    return decoded.where("kind = 'tag'").select("file_id", "seq", "format_id", "tag_id", "v_str", "v_list", "v_int", "v_bool")


def format_record(decoded: DataFrame) -> DataFrame:
    """One row per file with the technical fields; the last value of a field counts."""
    kinds = {"container": "v_str", "codec": "v_str", "codecProfile": "v_str", "tool": "v_str", "duration": "v_dbl", "bitrate": "v_dbl", "sampleRate": "v_int", "numberOfChannels": "v_int", "bitsPerSample": "v_int", "numberOfSamples": "v_int", "lossless": "v_bool"}
    f = decoded.where("kind = 'format'")
    return f.groupBy("file_id").agg(*[F.max_by(F.col(c), F.when(F.col("tag_id") == n, F.col("seq"))).alias(n) for n, c in kinds.items()])


def chapter_rows(decoded: DataFrame) -> DataFrame:
    got = F.from_json("v_json", "id string, title string, start long, end long, sample_offset long, time_scale long, url string")
    return decoded.where("kind = 'chapter'").select("file_id", "seq", got.alias("c")).select("file_id", "seq", "c.*")


def quality(decoded: DataFrame) -> DataFrame:
    """(file_id, kind, name, message) of warnings and errors, in order."""
    return decoded.where("kind IN ('warning', 'error')").select("file_id", "seq", "kind", F.col("tag_id").alias("name"), F.col("format_id").alias("file_type"), F.col("v_str").alias("message"))
