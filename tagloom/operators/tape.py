"""The structure of many JSON texts at once, as arrays over the Arrow buffer that holds them.

No text is parsed by itself: quotes, brackets and commas of the whole buffer are
found by comparisons, depths are running sums that start anew with each text, and
the container of a token is the last bracket of its depth before it. The grammar
is checked on neighbouring tokens, so a text that is cut or damaged is known.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CODES = {c: i for i, c in enumerate(b'{}[],:"')}
OPEN, CLOSE, LIST, UNLIST, COMMA, COLON, STRING, LITERAL = range(8)
#: Fixed value: a literal of JSON.
_LITERAL = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_KIND = np.full(256, LITERAL, np.int8)
for _c, _i in _CODES.items():
    _KIND[_c] = _i
_SHORT = np.zeros(256, bool)
_SHORT[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_UNICODE = re.compile(r"(?:\\u[0-9a-fA-F]{4})+")


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """String array of stretches of a buffer."""
    size = end - start
    at = np.append(0, np.cumsum(size))
    index = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[index])])


def _unicode(m: re.Match) -> str:
    units = bytes.fromhex(m.group().replace("\\u", ""))
    return units.decode("utf-16-be", "surrogatepass").encode("utf-8", "replace").decode("utf-8")


def unescaped(texts: pa.Array) -> pa.Array:
    """Contents of JSON strings, escapes undone; half of a surrogate pair becomes '?'."""
    if not pc.any(pc.match_substring(texts, "\\")).as_py():
        return texts
    coded = texts.dictionary_encode()
    words = pc.replace_substring(coded.dictionary, "\\\\", "\x00")
    if pc.any(pc.match_substring(words, "\\u")).as_py():
        words = pa.array([_UNICODE.sub(_unicode, w) if "\\u" in w else w for w in words.to_pylist()], pa.large_string())
    for a, b in (('\\"', '"'), ("\\/", "/"), ("\\b", "\b"), ("\\f", "\f"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        words = pc.replace_substring(words, a, b)
    return words.take(coded.indices)


class Tape:
    """Tokens of a batch of JSON texts in order; ``whole`` says which texts are valid, others have no tokens.

    Per token: ``row``, ``kind``, ``start`` and ``end`` in the buffer, ``depth``, ``parent`` (token number of the
    bracket around it, -1 outside), and ``value``: does it stand for a value.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, rows = data, len(offsets) - 1
        n, mark = len(data), _KIND[data]
        quote = np.flatnonzero(mark == STRING)
        self.slash = slash = np.flatnonzero(data == 92)
        good = np.ones(rows, bool)
        if len(slash):
            # a character is escaped by an odd number of backslashes before it
            first = np.append(True, np.diff(slash) > 1)
            at = np.arange(len(slash)) - np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))
            escape = slash[at % 2 == 0]
            hit = np.zeros(n + 1, bool)
            hit[escape + 1] = True
            quote = quote[~hit[quote]]
        row_of_quote = np.searchsorted(offsets, quote, "right") - 1
        per_row = np.bincount(row_of_quote, minlength=rows)
        good &= per_row % 2 == 0
        # the quotes of a text alternate between start and end, whatever stands in the texts before
        nth = np.arange(len(quote)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        begins = (nth % 2 == 0) & good[row_of_quote]
        starts = quote[begins]
        ends = quote[np.flatnonzero(begins) + 1]
        delta = np.zeros(n + 1, np.int8)
        delta[starts] += 1
        delta[ends + 1] -= 1
        inside = np.cumsum(delta[:n], dtype=np.int8).astype(bool)
        row_start = offsets[:-1]
        blank = _BLANK[data]
        # a byte order mark before the text
        a = row_start[np.diff(offsets) >= 3]
        a = a[(data[a] == 0xEF) & (data[a + 1] == 0xBB) & (data[a + 2] == 0xBF)]
        blank[np.concatenate([a, a + 1, a + 2])] = True
        literal = (mark == LITERAL) & ~inside & ~blank
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.append(False, literal[:-1]) & ~edge[:n] if n else literal
        l_start = np.flatnonzero(literal & ~before)
        after = np.append(literal[1:], False) & ~edge[1:] if n else literal
        l_end = np.flatnonzero(literal & ~after) + 1
        marks = np.flatnonzero((mark < STRING) & ~inside)
        start = np.concatenate([marks, starts, l_start])
        order = np.argsort(start, kind="stable")
        self.start = start[order]
        self.end = np.concatenate([marks + 1, ends + 1, l_end])[order]
        self.kind = np.concatenate([mark[marks], np.full(len(starts), STRING, np.int8), np.full(len(l_start), LITERAL, np.int8)])[order]
        self.row = np.searchsorted(offsets, self.start, "right") - 1

        # text inside strings
        wrong = np.flatnonzero((data < 32) & inside)
        if len(slash):
            wrong = np.concatenate([wrong, escape[~inside[escape]], escape[~_SHORT[data[np.minimum(escape + 1, n - 1)]]]])
            u = escape[data[np.minimum(escape + 1, n - 1)] == 117]
            for k in range(2, 6):
                at = np.minimum(u + k, n - 1)
                wrong = np.concatenate([wrong, u[~(_HEX[data[at]] & inside[at])]])
        good[np.searchsorted(offsets, wrong, "right") - 1] = False
        words = slices(data, l_start, l_end).dictionary_encode()
        sane = pc.match_substring_regex(words.dictionary, _LITERAL).to_numpy(zero_copy_only=False)
        good[np.searchsorted(offsets, l_start[~sane[words.indices.to_numpy()]], "right") - 1] = False
        self._structure(good, rows)

    def _structure(self, good: np.ndarray, rows: int) -> None:
        k = self.kind
        opens, closes = (k == OPEN) | (k == LIST), (k == CLOSE) | (k == UNLIST)
        running = np.cumsum(opens.astype(np.int64) - closes)
        count = np.bincount(self.row, minlength=rows)
        first = np.cumsum(count) - count
        base = np.where(first > 0, running[np.maximum(first - 1, 0)] if len(running) else 0, 0)
        inner = running - base[self.row]  # depth after the token
        last = np.cumsum(count) - 1
        full = count > 0
        good &= full
        good[full] &= inner[last[full]] == 0
        np.logical_and.at(good, self.row, inner >= 0)
        keep = good[self.row]
        for name in ("kind", "start", "end", "row"):
            setattr(self, name, getattr(self, name)[keep])
        k, inner, opens, closes = self.kind, inner[keep], opens[keep], closes[keep]
        n = len(k)
        number = np.arange(n)
        # depth of the container: that before an opening bracket, that before a closing one
        self.depth = np.where(opens, inner - 1, np.where(closes, inner + 1, inner))
        shift = max(1, int(n).bit_length())
        lead = number[opens]
        keys = (inner[opens] << shift) | lead
        sort = np.argsort(keys)
        place = np.searchsorted(keys[sort], (self.depth << shift) | number) - 1
        self.parent = np.where(self.depth > 0, lead[sort][np.maximum(place, 0)] if len(lead) else -1, -1)

        # grammar of neighbours; outside a container there is one value
        inside_object = (self.parent >= 0) & (k[np.maximum(self.parent, 0)] == OPEN)
        previous = np.append(-1, k[:-1])
        begins = np.append(True, self.row[1:] != self.row[:-1])[:n]
        starts_value = (k == STRING) | (k == LITERAL) | opens
        after_open = (previous == OPEN) & (np.append(-1, number[:-1]) == self.parent)
        key = inside_object & (k == STRING) & (after_open | (previous == COMMA))
        after_key = np.append(False, key[:-1])
        after_value = ~np.isin(previous, (OPEN, LIST, COMMA, COLON)) & ~after_key
        self.value = starts_value & ~key
        ok = np.select(
            [begins, key, k == COLON, self.value & inside_object, self.value, k == COMMA, k == CLOSE, k == UNLIST],
            [starts_value, True, after_key, previous == COLON, (self.parent >= 0) & np.isin(previous, (LIST, COMMA)), after_value & (self.parent >= 0), inside_object & (after_value | (previous == OPEN)), (self.parent >= 0) & ~inside_object & (after_value | (previous == LIST))],
            False,
        )
        np.logical_and.at(good, self.row, ok)
        self.whole = good
        self.value &= good[self.row]
        # the key of a member stands two tokens before its value
        self.key = np.where(self.value & inside_object, number - 2, -1)

    def text(self, token: np.ndarray) -> pa.Array:
        """Texts of tokens: strings without quotes and escapes, literals as they stand, null and -1 as ''; brackets with what they hold."""
        none = token < 0
        t = np.maximum(token, 0)
        if not len(self.kind):
            return pa.array([""] * len(token), pa.large_string())
        string = (self.kind[t] == STRING) & ~none
        start, end = self.start[t] + string, self.end[t] - string
        nested = (self.kind[t] == OPEN) | (self.kind[t] == LIST)
        if nested.any():
            closing = np.flatnonzero((self.kind == CLOSE) | (self.kind == UNLIST))
            close_of = np.zeros(len(self.kind), np.int64)
            close_of[self.parent[closing]] = self.end[closing]
            end = np.where(nested, close_of[t], end)
        null = (self.kind[t] == LITERAL) & (self.data[self.start[t]] == 110)
        end = np.where(none | null, start, end)
        raw = slices(self.data, start, end)
        return pc.if_else(pa.array(string), unescaped(raw), raw)

    def named(self, *names: str) -> np.ndarray:
        """Numbers of the values whose key is one of the names."""
        v, start, size, odd, texts = self._keys
        hit = np.zeros(len(v), bool)
        for name in names:
            word = np.frombuffer(name.encode(), np.uint8)
            like = np.flatnonzero(size == len(word))
            for j, c in enumerate(word):
                like = like[self.data[start[like] + j] == c]
            hit[like] = True
        if len(odd):
            hit[odd] = pc.is_in(texts, value_set=pa.array(names, pa.large_string())).to_numpy(zero_copy_only=False)
        return v[hit]

    @cached_property
    def _keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Values that have a key, start and size of the key; the positions of keys that are written with escapes, and what they say."""
        v = np.flatnonzero(self.key >= 0)
        key = self.key[v]
        start, end = self.start[key] + 1, self.end[key] - 1
        odd = np.flatnonzero(np.searchsorted(self.slash, end) > np.searchsorted(self.slash, start)) if len(self.slash) else v[:0]
        return v, start, end - start, odd, self.text(key[odd])

    def member(self, objects: np.ndarray, name: str) -> np.ndarray:
        """The value of a member of each object, -1 where there is none; of members of one name the last counts."""
        found = np.full(len(self.kind) + 1, -1, np.int64)
        values = self.named(name)
        found[self.parent[values]] = values
        return found[objects]

    def children(self, containers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``containers``, value): the values that stand directly in each container, in order."""
        place = np.full(len(self.kind) + 1, -1, np.int64)
        place[containers] = np.arange(len(containers))
        place[-1] = -1
        v = np.flatnonzero(self.value & (self.parent >= 0))
        of = place[self.parent[v]]
        v, of = v[of >= 0], of[of >= 0]
        order = np.argsort(of, kind="stable")
        return of[order], v[order]
