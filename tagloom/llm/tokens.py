"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: a distinct-word table. Texts are split into words in Spark; the words of
a bounded chunk of texts become one dictionary, so a text is a list of positions
in the dictionary of its chunk. The distinct words of all chunks are encoded
once each, their ids return to the chunk dictionaries by a join on the word, and
every text takes its ids by position. Decoding is a join of ids with the pieces
of the vocabulary.

A frequent word stands once per chunk, not once per occurrence, so no word is a
hot key; a chunk holds at most ``CHUNK_WORDS`` words (or one text).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.session import cut

#: Rank file of byte_bpe_50k; every function takes another path as a parameter.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words of one chunk, and rows of the Arrow batches that chunks are made of.
CHUNK_WORDS = 400_000


def ranks_path(path: str) -> str:
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(ranks_path(path), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def words(text: Column) -> Column:
    """ARRAY<STRING>: the words of a text in order; together they are the text. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0)), F.array().cast("array<string>"))


def _resplit(path: str):
    """Words of texts with characters that the JVM's Unicode tables don't know, by the tokenizer's own splitter."""
    import regex

    pattern = regex.compile(PATTERN)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else pattern.findall(t))

    return split


def chunked(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """Two kinds of rows: texts (chunk, id, ix: positions of their words) and dictionary entries (chunk, k, word)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0

        def flush(ids: list, lists: list[pa.Array]) -> pa.RecordBatch:
            nonlocal n
            col = pa.concat_arrays(lists)
            coded = pc.dictionary_encode(col.flatten().cast(pa.large_string()))
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False))))
            rows, size = len(col), len(coded.dictionary)
            chunk = part << 32 | n
            n += 1
            # texts first, then the entries of the dictionary
            ix_offsets = np.concatenate((offsets, np.full(size, offsets[-1]))).astype(np.int32)
            ix = pa.ListArray.from_arrays(pa.array(ix_offsets), coded.indices.cast(pa.int32()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows + size, chunk)),
                    pa.concat_arrays([pa.concat_arrays(ids), pa.nulls(size, pa.int64())]),
                    ix,
                    pa.concat_arrays([pa.nulls(rows, pa.int32()), pa.array(np.arange(size, dtype=np.int32))]),
                    pa.concat_arrays([pa.nulls(rows, pa.string()), coded.dictionary.cast(pa.string())]),
                ],
                ["chunk", "id", "ix", "k", "word"],
            )

        ids, lists, held = [], [], 0
        for b in batches:
            lengths = pc.list_value_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(lengths):
                room = np.searchsorted(np.cumsum(lengths[at:]), CHUNK_WORDS - held, side="right")
                take = int(room) or (0 if held else 1)
                if take:
                    part_of = b.slice(at, take)
                    ids.append(part_of.column(0).cast(pa.int64()))
                    lists.append(part_of.column(1))
                    held += int(lengths[at : at + take].sum())
                    at += take
                if at < len(lengths):
                    yield flush(ids, lists)
                    ids, lists, held = [], [], 0
        if ids:
            yield flush(ids, lists)

    text = F.col(text_col)
    split = F.when(text.rlike(r"\p{Cn}"), _resplit(path)(F.when(text.rlike(r"\p{Cn}"), text))).otherwise(words(text))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), split.alias("w")).mapInArrow(build, "chunk long, id long, ix array<int>, k int, word string")


def word_table(entries: DataFrame, path: str) -> DataFrame:
    """(word, ids): every distinct word once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return entries.select("word").distinct().mapInArrow(encode, "word string, ids array<int>")


def _dictionary(entries: pa.Table) -> pa.ListArray:
    k = entries.column("k").to_numpy()
    ids = entries.column("ids").combine_chunks()
    return pc.take(ids, pa.array(np.argsort(k, kind="stable")))


def _assemble(texts: pa.Table, entries: pa.Table) -> pa.Table:
    ix = texts.column("ix").combine_chunks()
    if not len(texts):
        return pa.table({"id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
    per_text = pc.list_value_length(ix).to_numpy(zero_copy_only=False)
    flat = ix.flatten()
    if not len(flat):
        return pa.table({"id": texts.column("id"), "ids": pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))})
    took = pc.take(_dictionary(entries), flat)
    lengths = np.concatenate(([0], np.cumsum(pc.list_value_length(took).to_numpy(zero_copy_only=False))))
    offsets = lengths[np.concatenate(([0], np.cumsum(per_text)))].astype(np.int32)
    return pa.table({"id": texts.column("id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), took.flatten())})


def _assemble_sizes(texts: pa.Table, entries: pa.Table) -> pa.Table:
    ix = texts.column("ix").combine_chunks()
    per_text = pc.list_value_length(ix).to_numpy(zero_copy_only=False) if len(texts) else np.zeros(0, np.int64)
    flat = ix.flatten().to_numpy()
    size = np.zeros(1, np.int64)
    if len(flat):
        size = pc.list_value_length(_dictionary(entries)).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(size[flat] if len(flat) else np.zeros(0, np.int64))))
    ends = np.concatenate(([0], np.cumsum(per_text))).astype(np.int64)
    return pa.table({"id": texts.column("id"), "n": pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())})


def _encoded(docs: DataFrame, id_col: str, text_col: str, path: str, sizes_only: bool) -> DataFrame:
    rows = cut(chunked(docs, id_col, text_col, path))
    entries = rows.where("word IS NOT NULL").select("chunk", "k", "word")
    filled = entries.join(word_table(entries, path), "word").select(F.col("chunk").alias("of"), "k", "ids")
    texts = rows.where("word IS NULL").select("chunk", "id", "ix")
    both = texts.groupBy("chunk").cogroup(filled.groupBy("of"))
    if sizes_only:
        return both.applyInArrow(_assemble_sizes, "id long, n long")
    return both.applyInArrow(_assemble, "id long, ids array<int>")


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_RANKS) -> DataFrame:
    """(id_col, ids): token ids of every row with an id, without special tokens.

    Empty and null texts give an empty list; markers of special tokens are plain
    text; repeated rows each give a row; rows without an id give none; other
    columns are not read.
    """
    return _encoded(docs, id_col, text_col, path, False).select(F.col("id").alias(id_col), "ids")


def token_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_RANKS) -> DataFrame:
    """(id_col, n): the number of tokens of every row, by the same word table."""
    return _encoded(docs, id_col, text_col, path, True).select(F.col("id").alias(id_col), "n")


def vocabulary(spark: SparkSession, path: str = DEFAULT_RANKS) -> DataFrame:
    """(id, piece BINARY) of the tokenizer; its size is that of the vocabulary."""
    ranks = _ranks(path)
    return spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array(ranks.keys(), pa.binary())}))


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", path: str = DEFAULT_RANKS) -> DataFrame:
    """(id_col, text): texts of lists ``ids``, by an id-to-piece join; null and empty lists give ''.

    ``id_col`` must be unique. Ids outside the vocabulary are left out; byte
    sequences that are not UTF-8 become U+FFFD.
    """
    vocab = F.broadcast(vocabulary(encoded.sparkSession, path))  # as many rows as the vocabulary has
    pieces = encoded.select(id_col, F.posexplode("ids").alias("pos", "id")).join(vocab, "id")
    texts = pieces.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("p"))
    texts = texts.select(id_col, F.expr("decode(unhex(array_join(transform(p, x -> x.h), '')), 'UTF-8')").alias("text"))
    return encoded.select(id_col).join(texts, id_col, "left").select(id_col, F.coalesce("text", F.lit("")).alias("text"))
