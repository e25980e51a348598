"""Python data source 'audio': files read by byte ranges, one partition per group of files.

``spark.read.format("audio").option("path", folder)`` gives event rows of local
(or mounted) files. Options: ``preset`` (all, minimal, metadata_only), ``mode``
(PERMISSIVE, FAILFAST), ``strategy`` (auto, full, header, probe, randomAccess), ``maxBytes``.

``auto`` chooses by size and format; every strategy gives the same rows, since a
decoder knows the true size of a file and gets any chunk it asks for.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tagloom import catalog
from tagloom.operators.strategy import CATEGORIES
from tagloom.sources.audio import DECODERS, decode_bytes
from tagloom.sources.decode.events import PRESETS
from tagloom.sources.ranges import PROVIDERS, open_object

SCHEMA = "path string, length long, loader string, seq int, kind string, format_id string, tag_id string, v_str string, v_int long, v_dbl double, v_bool boolean, v_bin binary, v_list array<string>, v_json string"
#: Files of one partition.
GROUP = 64


@dataclass
class Group(InputPartition):
    paths: tuple[str, ...]


class AudioReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options.get("path", ".")
        self.options = PRESETS[options.get("preset", "metadata_only")]
        self.fail = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.strategy = {"full": "fullDownload", "header": "headerOnly"}.get(options.get("strategy", "auto"), options.get("strategy", "auto"))
        self.decoders, self.loaders, self.provider = dict(DECODERS), catalog.loader_rows(), PROVIDERS[""]
        self.max_bytes = int(options.get("maxbytes", options.get("maxBytes", 1 << 62)))

    def partitions(self) -> list[InputPartition]:
        found = sorted(os.path.join(d, f) for d, _, files in os.walk(self.root) for f in files) if os.path.isdir(self.root) else [self.root]
        return [Group(tuple(found[i : i + GROUP])) for i in range(0, len(found), GROUP)] or [Group(())]

    def read(self, partition: Group) -> Iterator[tuple]:
        loaders = {key: loader for kind, key, loader, _, _ in self.loaders if kind == "ext"}
        for path in partition.paths:
            size = os.path.getsize(path) if os.path.exists(path) else 0
            if size >= self.max_bytes:
                continue
            ext = path.rpartition(".")[2].lower()
            loader = loaders.get(ext)
            cat = next((c for c, (exts, _) in CATEGORIES.items() if ext in exts.split()), "unknown")
            content = open_object(self.provider(path), self.strategy, cat)[0]
            for row in decode_bytes(content, loader, self.options, self.decoders):
                if self.fail and row[1] == "error":
                    raise ValueError(f"{path}: {row[4]}")
                yield (path, size, loader, *row)


class AudioSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return AudioReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AudioSource)
