"""Mapping freely entered values to a canonical list, unmatched values reported.

Method: a multi-pattern automaton (Aho-Corasick) over the canonical names and
their aliases finds embedded mentions; the longest match wins. Values without a
mention go to token-set similarity: common words are set aside, the rest may be
swapped, abbreviated or mistyped. Letter counts block the comparison: a name whose
letters differ by more than the allowed edits can make is not compared.

The canonical list is a dimension of bounded size and travels with the tasks; each
distinct value is judged once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.encoding import spread
from tagloom.llm.plain import plain_form
from tagloom.operators.packed import MAX_PROTECTED, genre_items
from tagloom.session import cut, small_rows

#: Edits that a value of at least so many letters may have; shorter ones must be exact.
EDITS = ((15, 3), (7, 2), (4, 1))
#: Least letters of an abbreviated word.
SHORTEST = 3
#: Buckets of letter counts.
BUCKETS = 64

_NUMBER = re.compile(r"^[(\[#]*\s*(?:no\.?\s*)?(\d{1,9})\s*[)\]]*$", re.I)
_LEAD = re.compile(r"^\(\s*(\d{1,9})\s*\)\s*(?=\S)")


def words(text: str) -> list[str]:
    """Lower-case words without accents; apostrophes belong to no word."""
    t = unicodedata.normalize("NFKD", plain_form(text)).casefold()
    t = "".join(c for c in t if not unicodedata.combining(c) and c not in "'’`´")
    return re.findall(r"[^\W_]+\.?", t)


def distance(a: str, b: str, most: int) -> int:
    """Edits between two strings, a swap of neighbours being one; more than ``most`` gives most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def _letters(text: str) -> np.ndarray:
    """How often each letter stands in a text; letters share buckets, which makes no two texts more unlike."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % BUCKETS, minlength=BUCKETS)


def allowed(length: int) -> int:
    return next((e for least, e in EDITS if length >= least), 0)


@dataclass
class Matcher:
    """Judges values against (id, number, name) rows."""

    rows: list[tuple[int, int | None, str]]
    by_number: dict[int, int] = field(default_factory=dict)
    forms: list[tuple[int, list[str]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        aliases: dict[str, int] = {}
        for ident, number, name in sorted(self.rows):
            if number is not None:
                self.by_number.setdefault(number, ident)
            w = [x.rstrip(".") for x in words(name)]
            if not w:
                continue
            self.forms.append((ident, w))
            aliases.setdefault(f" {' '.join(w)} ", ident)
            aliases.setdefault(f" {''.join(w)} ", ident)
            if len(w) > 2 and any(len(x) == 1 for x in w):
                aliases.setdefault(f" {' '.join(x for x in w if len(x) > 1)} ", ident)
        self.letters = np.array([_letters("".join(w)) for _, w in self.forms]).reshape(-1, BUCKETS)
        for alias, ident in aliases.items():
            self.machine.add_word(alias, (ident, len(alias)))
        if aliases:
            self.machine.make_automaton()
        self.judge = lru_cache(maxsize=200_000)(self._judge)

    def longest(self, text: str) -> int | None:
        """Id of the longest mention; of equally long ones the first."""
        if not self.forms:
            return None
        hits = [(-size, end, ident) for end, (ident, size) in self.machine.iter(text)]
        return min(hits)[2] if hits else None

    def near(self, bare: list[str], most: int) -> list[int]:
        """Positions of the names whose letters differ from those of the value by no more than so many edits can make; none beyond is nearer."""
        letters = _letters("".join(bare))
        return np.flatnonzero(np.abs(self.letters - letters).sum(1) <= 2 * most).tolist()

    def similar(self, w: list[str]) -> int:
        """Entry whose set of words is nearest within the allowed edits, 0 for none; ties go to none."""
        bare = [x.rstrip(".") for x in w]
        short = any(x.endswith(".") for x in w)
        most = allowed(len("".join(bare)))
        best: list[tuple[int, int]] = []
        for i in range(len(self.forms)) if short else self.near(bare, most):
            ident, name = self.forms[i]
            d = self.words_apart(bare, name, most)
            if d > most and short and len(w) == len(name):
                d = 0 if all(n.startswith(b) and len(b) >= SHORTEST if x.endswith(".") and n != b else distance(b, n, 1) <= (len(n) > 3) for x, b, n in zip(w, bare, name)) else most + 1
            if d <= most:
                best.append((d, ident))
        best.sort()
        return best[0][1] if best and (len(best) == 1 or best[1][0] > best[0][0]) else 0

    def words_apart(self, a: list[str], b: list[str], most: int) -> int:
        """Edits between two sets of words: common words are set aside, the rest is compared joined, in any order, and word by word."""
        rest = list(b)
        own = [x for x in a if x not in rest or rest.remove(x)]
        d = distance("".join(own), "".join(rest), most)
        if d > most:
            d = distance("".join(a), "".join(b), most)
        if d > most and len(own) == len(rest) > 1:
            d = self._by_words(own, rest, most)
        if d > most and len(a) > 1:
            d = distance("".join(sorted(a)), "".join(sorted(b)), min(most, 1))
            d = d if d <= min(most, 1) else most + 1
        return d

    @staticmethod
    def _by_words(a: list[str], b: list[str], most: int) -> int:
        """Edits when words may change places: each word goes to its nearest free one."""
        free, total = list(b), 0
        for x in a:
            d, y = min((distance(x, y, most), y) for y in free)
            free.remove(y)
            total += d
            if total > most:
                return most + 1
        return total

    def _judge(self, value: str) -> int:
        text = plain_form(value).strip().strip("\x00")
        if number := _NUMBER.match(text):
            return self.by_number.get(int(number.group(1)), 0)
        lead = _LEAD.match(text)
        rest = text[lead.end() :] if lead else text
        w = words(rest)
        bare = [x.rstrip(".") for x in w]
        if (ident := self.longest(f" {' '.join(bare)} ")) is not None:
            return ident
        if not w:
            return self.by_number.get(int(lead.group(1)), 0) if lead else 0
        if ident := self.similar(w):
            return ident
        # the same without remarks: a label before a colon, brackets and signs after the value, a word at either end
        trimmed = re.sub(r"^[^:]{1,20}:\s*|\s*[(\[][^)\]]*[)\]]\s*$|\s+-\s+\w+\s*$", "", rest)
        if trimmed != rest and (ident := self.similar(words(trimmed))):
            return ident
        for part in (w[1:], w[:-1]):
            if len(w) > 1 and len("".join(part)) > 5 and (ident := self.similar(part)):
                return ident
        return self.by_number.get(int(lead.group(1)), 0) if lead else 0


def mapped_values(tags: DataFrame, genres: DataFrame) -> DataFrame:
    """(rec_id, genre, genre_id): freely typed single genres and the entry each means, 0 for none.

    Left out are null and blank values, values that name several genres, and
    values that are an entry character by character. Repeated rows give their
    case once; an empty list gives 0 for every value.
    """
    rows = [tuple(r) for r in small_rows(genres.select("genre_id", "genre_no", "genre_name").where("genre_id IS NOT NULL AND genre_name IS NOT NULL"), MAX_PROTECTED)]
    names = [r[2] for r in rows]

    def to_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rows)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([matcher.judge(v) for v in b.column(0).to_pylist()], pa.int32())], ["genre", "genre_id"])

    free = tags.select("rec_id", "genre").where(F.col("genre").isNotNull() & F.col("genre").rlike(r"(?U)[^\s\p{Cf}]"))
    if names:
        free = free.where(~F.col("genre").isin(names))
    single = free.where(F.size(genre_items(F.col("genre"), names)) < 2)
    single = single.distinct()
    # each distinct value is judged once, however many rows have it, in tasks enough for a costly step
    values = cut(single.select("genre").distinct())
    judged = spread(values, "genre", values.count()).mapInArrow(to_entry, "genre string, genre_id int")
    return single.join(judged, "genre").select("rec_id", "genre", "genre_id")
