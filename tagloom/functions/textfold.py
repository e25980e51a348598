"""Text folding as Column expressions: one comparison key for texts that read the same.

The character table is built from Unicode decompositions; only the look-alike
pairs are listed, since no rule gives them.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter.
LOOKALIKE_CYRILLIC = dict(zip("АВЕКМНОРСТХаеорсухіјѕЅІЈһԁԛԝҮүѵ", "ABEKMHOPCTXaeopcyxijsSIJhdqwYyv"))
LOOKALIKE_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικ", "ABEZHIKMNOPTYXovik"))

# Blanks beside the plain one, characters without shape, hyphens beside the plain one.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
HYPHENS = "\u2010\u2011\ufe63\uff0d"

#: Java character class of every blank, for use inside brackets.
JAVA_BLANK = r"\s\u0085   -     　"
_JAVA_UNSEEN = r"[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁩﻿̀-゙゚ͯ]"

_RANGES = [(0xA0, 0x250), (0x370, 0x400), (0x400, 0x460), (0x1E00, 0x2000), (0x2100, 0x2190), (0x3040, 0x3100), (0xFB00, 0xFB07), (0xFF01, 0xFFA0), (0x1D400, 0x1D800)]


@cache
def base_table() -> tuple[str, str]:
    """(from, to): every character of the ranges whose decomposition starts with another visible character."""
    src, dst = [], []
    looks = LOOKALIKE_CYRILLIC | LOOKALIKE_GREEK
    for lo, hi in _RANGES:
        for cp in range(lo, hi):
            ch = chr(cp)
            base = unicodedata.normalize("NFKD", ch)
            base = "".join(c for c in base if not unicodedata.combining(c))[:1] or ch
            base = looks.get(base, base).lower()[:1]
            if base != ch and not base.isspace():
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


def fold_key(col: Column) -> Column:
    """Key of a text without case, accents, width, blanks, invisible characters and look-alikes; null stays null."""
    src, dst = base_table()
    seen = F.regexp_replace(col, _JAVA_UNSEEN + "|[" + JAVA_BLANK + "]", "")
    return F.lower(F.translate(seen, src, dst))


@cache
def _py_table() -> dict[int, str]:
    src, dst = base_table()
    return {ord(a): b for a, b in zip(src, dst)}


def fold_key_py(text: str) -> str:
    """The same key in plain Python, for dimension rows on the driver."""
    out = []
    for ch in text:
        if ch.isspace() or ch in BLANKS or ch in INVISIBLE or 0x300 <= ord(ch) <= 0x36F or ch in "\u3099\u309a":
            continue
        out.append(ch)
    return "".join(out).translate(_py_table()).lower()


@cache
def width_table() -> tuple[str, str]:
    """(from, to): wide and mathematical forms of one letter, digit or mark."""
    src, dst = [], []
    for lo, hi in [(0xFF01, 0xFF5F), (0x1D400, 0x1D800)]:
        for cp in range(lo, hi):
            if unicodedata.decomposition(chr(cp))[:6] in ("<wide>", "<font>"):
                src.append(chr(cp))
                dst.append(unicodedata.normalize("NFKC", chr(cp)))
    return "".join(src), "".join(dst)


def plain_words(col: Column) -> Column:
    """Lower-case text in ordinary width with single blanks, without invisible characters; accents stay."""
    src, dst = width_table()
    # most texts are ASCII and need none of the replacements
    odd = col.rlike(r"[^\x00-\x7f]")
    seen = F.when(odd, F.translate(F.regexp_replace(col, "[" + INVISIBLE + "]", ""), src, dst)).otherwise(col)
    return F.trim(F.regexp_replace(F.lower(seen), f"[{JAVA_BLANK}]+", " "))


def strip_blanks(col: Column) -> Column:
    """Text without blanks of any kind at either end."""
    return F.regexp_replace(col, rf"^[{JAVA_BLANK}]+|[{JAVA_BLANK}]+$", "")
