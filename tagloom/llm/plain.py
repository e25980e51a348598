"""Visually identical text with different characters: one plain form per text.

Method: a compiled longest-match transducer over grapheme clusters. For each
script of a word there is one trie of clusters and their plain forms, built by
rule from Unicode data: widths, blanks, hyphens, invisible characters, letters with
marks in every spelling, Hangul from its parts, and the look-alikes of the script.
Two rules that disagree on a cluster are an error. A text is read once, each place
takes its longest cluster.

The operator is a projection: Python sees only values with a character outside
ASCII, each distinct value of a batch once.
"""

from __future__ import annotations

import unicodedata
from functools import cache, lru_cache
from itertools import permutations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.textfold import BLANKS, HYPHENS, INVISIBLE
from tagloom.llm.encoding import garbled_values, long_fields

# Look-alike letters, other script -> Latin and the pairs that also work the other way round.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮаеіјорѕсухԁһԛԝѵү", "ABESIJKMHOPCTYXYaeijopscyxdhqwvy"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳανορυικϲ", "ABEZHIKMNOPTYXCjavopuikc"))
TO_CYRILLIC = dict(zip("ABEKMHOPCTXaeopcyx", "АВЕКМНОРСТХаеорсух"))
TO_GREEK = dict(zip("ABEZHIKMNOPTYXov", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"))

_UNSEEN = INVISIBLE + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Compatibility forms whose plain form is an ordinary character of the same text.
_KINDS = {"<wide>", "<narrow>", "<font>", "<compat>"}
_RANGES = [(0xFF01, 0xFFEF), (0x1D400, 0x1D800), (0xFB00, 0xFB07), (0x2160, 0x2180), (0x3131, 0x318F)]
_MARKS = "\\u0300-\\u036f\\u3099\\u309a"


def _add(table: dict[str, str], cluster: str, plain: str) -> None:
    if table.setdefault(cluster, plain) != plain:
        raise ValueError(f"two plain forms for {cluster!r}")


@cache
def cluster_table() -> dict[str, str]:
    """Cluster -> plain form; raises where two rules disagree or a plain form is not stable."""
    table: dict[str, str] = {}
    for ch in BLANKS:
        _add(table, ch, " ")
    for ch in HYPHENS:
        _add(table, ch, "-")
    for ch in _UNSEEN:
        _add(table, ch, "")
    for lo, hi in _RANGES:
        for cp in range(lo, hi):
            ch = chr(cp)
            if ch in table or unicodedata.decomposition(ch).partition(" ")[0] not in _KINDS:
                continue
            _add(table, ch, unicodedata.normalize("NFKC", ch))
    for cp in [*range(0x340, 0x375), *range(0x37E, 0x388), *range(0x1F00, 0x2000), *range(0x2126, 0x212C)]:
        ch = chr(cp)
        if unicodedata.normalize("NFC", ch) != ch:
            _add(table, ch, unicodedata.normalize("NFC", ch))
    for plain in set(table.values()):
        if unicodedata.normalize("NFC", plain) != plain and not unicodedata.combining(plain[:1] or "a") or any(c in table for c in plain):
            raise ValueError(f"{plain!r} is not stable")
    return table


_WORD = regex.compile(rf"[\p{{L}}\p{{M}}{''.join(map(regex.escape, _UNSEEN))}]+")


def _script(ch: str) -> str:
    if "Ͱ" <= ch <= "Ͽ" or "ἀ" <= ch <= "῿":
        return "G"
    if "Ѐ" <= ch <= "ԯ":
        return "C"
    return "L" if ch < "ɐ" or "Ḁ" <= ch <= "ỿ" else "o"


_INTO = {("C", "L"): CYRILLIC, ("G", "L"): GREEK, ("L", "C"): TO_CYRILLIC, ("L", "G"): TO_GREEK}


def _decisive(ch: str, other: str) -> bool:
    """Can this base letter stand for no letter of the other script?"""
    return ch not in _INTO.get((_script(ch), other), {})


@cache
def _composed() -> dict[str, str]:
    """Letter with marks, in any order of the marks -> the one letter it composes to, by rule; Hangul from its parts."""
    found: dict[str, str] = {}
    for cp in [*range(0xC0, 0x3100), *range(0xF900, 0xFB50)]:
        parts = unicodedata.normalize("NFD", chr(cp))
        whole = unicodedata.normalize("NFC", parts)
        if len(parts) < 2 or len(whole) > 1:
            continue
        for marks in permutations(parts[1:]):
            if unicodedata.normalize("NFC", parts[0] + "".join(marks)) == whole:
                found[parts[0] + "".join(marks)] = whole
                for k in range(1, len(marks)):
                    begun = unicodedata.normalize("NFC", parts[0] + "".join(marks[:k]))
                    if len(begun) == 1:
                        found[begun + "".join(marks[k:])] = whole
    for lead in range(19):
        for vowel in range(21):
            for tail in range(28):
                jamo = chr(0x1100 + lead) + chr(0x1161 + vowel) + (chr(0x11A7 + tail) if tail else "")
                found[jamo] = chr(0xAC00 + (lead * 21 + vowel) * 28 + tail)
    return found


@cache
def transducer(script: str | None) -> dict:
    """The compiled mapping of the words of a script (None: text that keeps its letters): a trie over clusters.

    It holds the cluster table, letters with marks in every spelling of the letter, and the look-alikes of the
    script. Two rules that disagree on a cluster are an error.
    """
    looks: dict[str, str] = {}
    for (_, to), pairs in _INTO.items():
        if to == script:
            for a, b in pairs.items():
                _add(looks, a, b)
    singles = {a: "".join(looks.get(c, c) for c in b) for a, b in cluster_table().items()}
    table = dict(singles)
    for a, b in looks.items():
        _add(table, a, b)
    spellings: dict[str, list[str]] = {}
    for a, b in [*singles.items(), *looks.items()]:
        if len(b) == 1:
            spellings.setdefault(b, []).append(a)
    for parts, whole in _composed().items():
        if parts[0] in looks:
            continue
        for first in [parts[0], *spellings.get(parts[0], [])]:
            _add(table, first + parts[1:], whole)
    for mark, plain in (("\uff9e", "\u3099"), ("\uff9f", "\u309a")):
        for a, b in singles.items():
            whole = unicodedata.normalize("NFC", b + plain)
            if 0xFF66 <= ord(a) <= 0xFF9D and len(whole) == 1:
                _add(table, a + mark, whole)
    for cp in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        # a letter with marks whose base is a look-alike
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0] in looks:
            whole = unicodedata.normalize("NFC", looks[parts[0]] + parts[1:])
            for spelling in {chr(cp), parts}:
                if spelling not in singles:
                    _add(table, spelling, whole)
    root: dict = {}
    for cluster, plain in table.items():
        node = root
        for ch in cluster:
            node = node.setdefault(ch, {})
        node[""] = plain
    return root


def _pass(text: str, start: int, end: int, root: dict, out: list[str]) -> None:
    """One walk over text[start:end]: the longest cluster at each place gives its plain form; invisible characters inside it don't count."""
    i = start
    while i < end:
        node = root.get(text[i])
        if node is None:
            out.append(text[i])
            i += 1
            continue
        best, to, k = node.get("", text[i]), i + 1, i + 1
        while k < end:
            ch = text[k]
            following = node.get(ch)
            if following is None:
                if ch not in _UNSEEN:
                    break
            else:
                node = following
                if "" in node:
                    best, to = node[""], k + 1
            k += 1
        out.append(best)
        i = to


@cache
def _letters_of(ch: str) -> str:
    """The plain base letters a character stands for."""
    return "".join(c for c in unicodedata.normalize("NFD", cluster_table().get(ch, ch)) if c.isalpha())


def _scripts(words: list[str]) -> list[str | None]:
    """The script whose look-alikes each word takes, None where it keeps its letters."""
    base = ["".join(map(_letters_of, w)) for w in words]
    scripts = [{_script(c) for c in b} - {"o"} for b in base]
    none: list[str | None] = [None] * len(words)
    if not any(s - {"L"} for s in scripts) or all(len(s) < 2 for s in scripts) and not any("L" in s for s in scripts):
        return none
    own = [{s for s in sc if any(_script(c) == s and all(_decisive(c, o) for o in "LCG" if (s, o) in _INTO) for c in b)} for b, sc in zip(base, scripts)]
    sure = [next(iter(o)) for o in own if len(o) == 1]
    most = max(set(sure), key=sure.count) if sure else None
    for i, (b, sc) in enumerate(zip(base, scripts)):
        if not sc or sc == {"L"} or len(own[i]) > 1:
            continue
        if len(sc) == 1:
            # a word of look-alikes only, in a text that has no other word of its script
            (s,) = sc
            if own[i] or s in sure or most != "L" or len(b) < 2:
                continue
            to = "L"
        elif own[i]:
            (to,) = own[i]
        else:
            counts = {s: sum(_script(c) == s for c in b) for s in sc}
            to = most if most in sc else max(sorted(counts), key=lambda s: (counts[s], s == "L"))
        if len({_script(_INTO.get((_script(c), to), {}).get(c, c)) for c in b}) == 1:
            none[i] = to
    return none


@lru_cache(maxsize=100_000)
def plain_form(text: str) -> str:
    """The plain form of one text in one pass; plain texts are their own form."""
    if text.isascii():
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    out: list[str] = []
    at, common = 0, transducer(None)
    for (a, b), script in zip(spans, _scripts([text[a:b] for a, b in spans])):
        _pass(text, at, a, common, out)
        _pass(text, a, b, common if script is None else transducer(script), out)
        at = b
    _pass(text, at, len(text), common, out)
    return "".join(out)


@F.pandas_udf(T.StringType())
def _plain(s: pd.Series) -> pd.Series:
    known = {v: plain_form(v) for v in s.dropna().unique()}
    return pd.Series([known.get(v) for v in s], index=s.index, dtype=object)


def plain_text(text: Column) -> Column:
    """Plain form of a text column; null stays null, ASCII texts don't leave the JVM."""
    odd = text.rlike(r"[^\x00-\x7f]")
    return F.when(odd, _plain(F.when(odd, text))).otherwise(text)


FIELDS = ["title", "artist"]


def plain_values(tags: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(rec_id, fieldname, value, plain) of every non-null value; equal names have equal ``plain``."""
    return long_fields(tags, fields).withColumn("plain", plain_text(F.col("value")))


def changed_values(tags: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(rec_id, fieldname, value, plain): values that are not in plain form, without those whose encoding is wrong.

    Null, empty and ASCII values are none; line breaks, tabs and plain blanks
    change nothing; repeated rows give their case once.
    """
    odd = plain_values(tags, fields).where(F.col("value").rlike(r"[^\x00-\x7f]") & (F.col("plain") != F.col("value"))).distinct()
    return odd.join(garbled_values(tags).select("rec_id", "fieldname").distinct(), ["rec_id", "fieldname"], "left_anti")
