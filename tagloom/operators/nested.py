"""Deeply nested semi-structured records: flat child tables that keep their parents.

Method: Arrow-buffer flattening without row parsing. The buffer of a batch of
payloads becomes one tape of tokens by array operations (``tape``); each nesting
level is then a list array over the tape. A child table is emitted from the
flattened values, the parent of each child comes from the list-parent-indices
kernel, its position from the offsets, and keys travel by vectorised ``take``. A
member may be of another type in every payload, since no type is declared. The
operator is a map over batches and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tagloom.operators.tape import LIST, LITERAL, OPEN, STRING, Tape, buffer

_RECORD_MEMBERS = ("native", "format", "common", "quality")
OUT = "raw_id long, kind string, parent_key string, pos int, item_name string"
_SCHEMA = pa.schema([("raw_id", pa.int64()), ("kind", pa.string()), ("parent_key", pa.string()), ("pos", pa.int32()), ("item_name", pa.string())])
#: Bytes of payloads that are taken apart at once; a longer payload is taken by itself.
CHUNK = 1 << 20


def _child(of: np.ndarray, parents: int, columns: dict[str, pa.Array]) -> tuple[dict[str, pa.Array], pa.Array]:
    """Columns of the parents taken along to their children, and each child's position; ``of`` is the parent of each child, ascending."""
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=parents))), pa.int32())
    nested = pa.ListArray.from_arrays(offsets, pa.nulls(len(of)))
    up = pc.list_parent_indices(nested)
    pos = pc.subtract(pa.array(np.arange(len(of)), pa.int32()), pc.take(offsets, up))
    return {k: pc.take(v, up) for k, v in columns.items()}, pos


def _objects(tape: Tape, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``values``, object): the objects of a list, or the one object that stands where a list could stand."""
    kind = np.where(values >= 0, tape.kind[np.maximum(values, 0)], -1) if len(tape.kind) else np.full(len(values), -1)
    single, lists = np.flatnonzero(kind == OPEN), np.flatnonzero(kind == LIST)
    of, child = tape.children(values[lists])
    held = tape.kind[child] == OPEN
    of, child = np.concatenate([single, lists[of[held]]]), np.concatenate([values[single], child[held]])
    order = np.argsort(of, kind="stable")
    return of[order], child[order]


def _is(tape: Tape, values: np.ndarray, kind: int) -> np.ndarray:
    return (values >= 0) & (tape.kind[np.maximum(values, 0)] == kind) if len(tape.kind) else np.zeros(len(values), bool)


def _formats(tape: Tape, native: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(record, format id, tags value) for the native member of each record, in order of appearance."""
    objects, lists = np.flatnonzero(_is(tape, native, OPEN)), np.flatnonzero(_is(tape, native, LIST))
    of, child = tape.children(native[lists])
    held = tape.kind[child] == OPEN
    of = np.concatenate([objects, lists[of[held]]])
    entry = np.concatenate([native[objects], child[held]])
    alone = np.arange(len(of)) < len(objects)
    kind, tags = tape.member(entry, "type"), tape.member(entry, "tags")
    number = _is(tape, kind, LITERAL) & np.isin(tape.data[tape.start[np.maximum(kind, 0)]], list(b"-0123456789")) if len(tape.kind) else alone[:0]
    typed = (_is(tape, kind, STRING) | number) & (~alone | (tags >= 0))
    # an entry says its type, or its members are formats
    open_ = ~typed & (alone | (kind < 0) & (tags < 0))
    by, member = tape.children(entry[open_])
    record = np.concatenate([of[typed], of[open_][by]])
    name = pa.concat_arrays([tape.text(kind[typed]), tape.text(tape.key[member])])
    value = np.concatenate([tags[typed], member])
    order = np.lexsort((np.concatenate([entry[typed], member]), record))
    return record[order], name.take(pa.array(order)), value[order]


def _records(tape: Tape, rows: int) -> np.ndarray:
    """The first object of each text, outermost first, that has a member of a record; -1 where there is none."""
    found = np.full(rows, -1, np.int64)
    holder = np.unique(tape.parent[tape.named(*_RECORD_MEMBERS)])
    order = np.lexsort((holder, tape.depth[holder], tape.row[holder]))[::-1]
    found[tape.row[holder[order]]] = holder[order]
    return found


def _layers(tape: Tape, without: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row, text): strings of the texts without a record that may hold JSON themselves, outermost first."""
    v = np.flatnonzero(tape.value & (tape.kind == STRING))
    v = v[np.isin(tape.row[v], without)]
    texts = tape.text(v)
    like = np.flatnonzero(pc.match_substring_regex(texts, r'^[\s\x{feff}]*[{\["]').to_numpy(zero_copy_only=False))
    order = like[np.lexsort((v[like], tape.depth[v[like]], tape.row[v[like]]))]
    return tape.row[v[order]], texts.take(pa.array(order))


def _flatten(raw_id: pa.Array, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(row of each output row, output rows) of the texts."""
    tape = Tape(*buffer(texts))
    found = _records(tape, len(texts))
    without = np.flatnonzero((found < 0) & tape.whole)
    if len(without):
        rows, inner = _layers(tape, without)
        if len(rows):
            parts = list(_flatten(raw_id.take(pa.array(rows)), inner))
            # of several texts in one, the first with a record counts
            first: np.ndarray = np.full(len(texts), len(rows), np.int64)
            for at, _ in parts:
                np.minimum.at(first, rows[at], at)
            for at, b in parts:
                keep = first[rows[at]] == at
                yield rows[at[keep]], b.filter(pa.array(keep))
    rows = np.flatnonzero(found >= 0)
    record = found[rows]
    top = {"raw_id": raw_id.take(pa.array(rows)), "row": pa.array(rows)}

    of, name, tags = _formats(tape, tape.member(record, "native"))
    by, tag = _objects(tape, tags)
    # formats that are listed twice in a record continue each other
    code = name.dictionary_encode()
    words = max(1, len(code.dictionary))
    pairs, group = np.unique(of[by] * words + code.indices.to_numpy()[by], return_inverse=True)
    order = np.argsort(group, kind="stable")
    cols, pos = _child(group[order], len(pairs), {k: v.take(pa.array(pairs // words)) for k, v in top.items()} | {"parent_key": code.dictionary.take(pa.array(pairs % words))})
    if len(order):
        yield _emit("tag", cols, pos, tape.text(tape.member(tag[order], "id")))

    form = tape.member(record, "format")
    form = np.where(_is(tape, form, OPEN), form, -1)
    cols, value = top | {"parent_key": pa.array([""] * len(rows), pa.large_string())}, tape.member(form, "chapters")
    while True:
        of, chapter = _objects(tape, value)
        if not len(chapter):
            return
        cols, pos = _child(of, len(value), cols)
        yield _emit("chapter", cols, pos, tape.text(tape.member(chapter, "title")))
        here = pc.cast(pos, pa.large_string())
        path = pc.if_else(pc.equal(cols["parent_key"], pa.scalar("", pa.large_string())), here, pc.binary_join_element_wise(cols["parent_key"], here, pa.scalar(".", pa.large_string())))
        cols, value = cols | {"parent_key": path}, tape.member(chapter, "chapters")


def _emit(kind: str, cols: dict[str, pa.Array], pos: pa.Array, name: pa.Array) -> tuple[np.ndarray, pa.RecordBatch]:
    out = [cols["raw_id"], pa.repeat(kind, len(pos)), cols["parent_key"].cast(pa.string()), pos.cast(pa.int32()), name.cast(pa.string())]
    return cols["row"].to_numpy(zero_copy_only=False), pa.RecordBatch.from_arrays(out, schema=_SCHEMA)


def flatten_batch(raw_id: pa.Array, payload: pa.Array) -> Iterator[pa.RecordBatch]:
    valid = pc.and_(raw_id.is_valid(), payload.is_valid())
    raw_id, payload = raw_id.filter(valid).cast(pa.int64()), payload.filter(valid)
    ends = np.cumsum(pc.binary_length(payload).to_numpy(zero_copy_only=False)) if len(payload) else np.zeros(0, np.int64)
    at = 0
    while at < len(payload):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        for _, b in _flatten(raw_id.slice(at, to - at), payload.slice(at, to - at)):
            yield b
        at = to


def flatten_records(raw: DataFrame) -> DataFrame:
    """raw_id, kind, parent_key, pos, item_name: one row per tag and chapter object of each payload.

    Null, empty, blank or damaged payloads, payloads without a record and rows
    without raw_id give no rows. A record inside a JSON string counts where the
    payload has none outside strings. Entries that are no objects hold no place. A name
    that is an object or a list stands as its JSON text. Rows delivered twice under
    one raw_id must be removed by the caller; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from flatten_batch(b.column(0), b.column(1))

    return raw.selectExpr("raw_id", "payload").mapInArrow(run, OUT)
