"""Sentences and terms of many texts at once, as 64-bit hashes.

The texts of a batch are one array of code points. Character classes and lower
case come from tables, word and sentence borders from comparisons of neighbours,
and the hash of any stretch of characters is a difference of running sums, so no
step handles a single word in Python. Terms are words, pairs of neighbouring
words, and, in scripts without blanks, runs of two to four characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Characters handled at once; a longer text is cut at line ends only.
CHUNK = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)

_WORD, _DIGIT, _EAST, _JOIN, _END, _CLOSE, _BLANK, _LINE, _EAST_END = 1, 2, 3, 4, 5, 6, 7, 8, 9


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case plus 1, so that no character is 0) of every code point; digits become 0."""
    kind, low = np.zeros(0x110000, np.uint8), np.arange(1, 0x110001, dtype=np.uint64)
    for cp in range(0x20000):
        ch = chr(cp)
        if ch.isdecimal():
            kind[cp], low[cp] = _DIGIT, ord("0") + 1
        elif ch.isalnum():
            kind[cp] = _WORD
            if len(ch.lower()) == 1:
                low[cp] = ord(ch.lower()) + 1
        elif ch.isspace():
            kind[cp] = _BLANK
    for lo, hi in ((0x3041, 0x3097), (0x309D, 0x3100), (0x3400, 0xA000), (0x20000, 0x32000)):
        kind[lo:hi] = _EAST
    for chars, k in (("'’-", _JOIN), (".!?…", _END), ("\"”»)", _CLOSE), ("\r\n", _LINE), ("。！？", _EAST_END)):
        for ch in chars:
            kind[ord(ch)] = k
    kind[0x30FB] = 0
    return kind, low


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    up, down = np.full(n, _BASE), np.full(n, _BACK)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Terms:
    """Terms of a piece: sentences with their document and hash, and each term once per sentence.

    The lowest bit of a term is set for a pair of words.
    """

    sent_doc: np.ndarray
    sent_hash: np.ndarray
    term_sent: np.ndarray
    term_hash: np.ndarray


def _stretches(run: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mixed((run[end] - run[start]) * down[start])


def _neighbours(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flag of the character before, and of the one after."""
    before, after = np.zeros_like(flag), np.zeros_like(flag)
    before[1:], after[:-1] = flag[:-1], flag[1:]
    return before, after


def terms(texts: list[str]) -> Terms:
    """Terms of the texts; ``sent_doc`` counts the texts from 0."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.intp)
    kinds, lower = _tables()
    kind, low = kinds[codes], lower[codes]
    doc_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    digit = kind == _DIGIT
    more = digit & _neighbours(digit)[0]
    dropped = np.flatnonzero(more)
    if len(dropped):
        keep = ~more
        doc_end = doc_end - np.searchsorted(dropped, doc_end)
        kind, low = kind[keep], low[keep]
    n = len(low)
    up, down = _powers(1 << max(10, int(n + 1).bit_length()))
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(np.multiply(low, up[:n], out=low), out=run[1:])

    inner = (kind > 0) & (kind <= _EAST)
    before, after = _neighbours(inner)
    inner |= (kind == _JOIN) & before & after
    before, after = _neighbours(inner)
    start, end = np.flatnonzero(inner & ~before), np.flatnonzero(inner & ~after) + 1

    # a sentence starts after a line end, an eastern full stop, or blanks that follow a full stop and closing marks
    stop = kind == _END
    closed = np.zeros(n, bool)
    closed[2:] |= (kind[1:-1] == _CLOSE) & stop[:-2]
    closed[3:] |= (kind[2:-1] == _CLOSE) & (kind[1:-2] == _CLOSE) & stop[:-3]
    ends = (kind == _LINE) | (kind == _EAST_END) | (kind == _BLANK) & (_neighbours(stop)[0] | closed)
    border = np.flatnonzero(ends)
    at = np.searchsorted(border, start)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    sent = np.cumsum(np.diff(at, prepend=-1) > 0) - 1
    sent_doc = np.searchsorted(doc_end, start[first], "right")

    word = _stretches(run, down, start, end)
    chain = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * up[: len(word)], out=chain[1:])
    stops = np.append(first[1:], len(word))
    sent_hash = _stretches(chain, down, first, stops) if len(first) else np.zeros(0, np.uint64)

    east = np.zeros(len(word), bool)
    east[np.searchsorted(start, np.flatnonzero(kind == _EAST), "right") - 1] = True
    plain = ~east
    pair = np.flatnonzero(plain[:-1] & plain[1:] & (sent[:-1] == sent[1:])) if len(word) else np.zeros(0, np.int64)
    hashes, of = [word[plain] & ~np.uint64(1), _mixed(word[pair] * _NEXT + word[np.minimum(pair + 1, max(len(word) - 1, 0))]) | np.uint64(1)], [sent[plain], sent[pair]]
    if east.any():
        sizes = (end - start)[east]
        stop_at, own = np.repeat(end[east], sizes), np.repeat(sent[east], sizes)
        here = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start[east], sizes)
        for k in (2, 3, 4):
            fits = here + k <= stop_at
            hashes.append(_stretches(run, down, here[fits], here[fits] + k) & ~np.uint64(1))
            of.append(own[fits])
    h, s = np.concatenate(hashes), np.concatenate(of)
    return Terms(sent_doc, sent_hash, s, h)


def once(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The values (64 bits), each once per group, in no order."""
    pair = _mixed(value.view(np.uint64) + _NEXT * group.astype(np.uint64))
    order = np.argsort(pair)
    pair = pair[order]
    return value[order[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]]


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each stands; a sort is much faster than a hash table here."""
    v = np.sort(values)
    at = np.flatnonzero(np.append(True, v[1:] != v[:-1])[: len(v)])
    return v[at], np.diff(np.append(at, len(v)))


class Lookup:
    """Numbers of known hashes by their highest bits; hashes that share these are searched."""

    BITS = 20

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes.view(np.uint64)
        self.order = np.argsort(self.hashes, kind="stable")
        self.sorted = self.hashes[self.order]
        place = self.hashes >> np.uint64(64 - self.BITS)
        self.slot = np.zeros(1 << self.BITS, np.int32)
        self.slot[place] = np.arange(1, len(hashes) + 1)
        self.slot[np.flatnonzero(np.bincount(place.astype(np.int64), minlength=1 << self.BITS) > 1)] = -1

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, numbers) of the hashes that are known."""
        slot = self.slot[h >> np.uint64(64 - self.BITS)]
        at = np.flatnonzero(slot)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = slot[at].astype(np.int64) - 1
        shared = np.flatnonzero(number < 0)
        number[shared] = self.order[np.minimum(np.searchsorted(self.sorted, h[at[shared]]), len(self.sorted) - 1)]
        hit = self.hashes[number] == h[at]
        return at[hit], number[hit]


def pieces(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """(texts, documents): the texts in chunks, and the number of each; a longer text is cut at line ends, so no sentence is divided."""
    held, docs, size = [], [], 0
    for i, t in enumerate(texts):
        for part in _parts(t or ""):
            if held and size + len(part) > CHUNK:
                yield held, np.array(docs)
                held, docs, size = [], [], 0
            held.append(part)
            docs.append(i)
            size += len(part) + 1
    if held:
        yield held, np.array(docs)


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind("\n", at, at + CHUNK)
        if cut < 0 and (cut := text.find("\n", at)) < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]
