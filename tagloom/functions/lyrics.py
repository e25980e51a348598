"""Timed lyrics (LRC) and Lyrics3 fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STAMP = r"\[(\d{2}):(\d{2})\.(\d{2,3})\]"


def stamp_ms(line: Column) -> Column:
    """Milliseconds of the first time stamp of a line; two digits are hundredths, three are thousandths."""
    m, s, f = (F.regexp_extract(line, _STAMP, i) for i in (1, 2, 3))
    return F.when(m != "", (m.cast("long") * 60 + s.cast("long")) * 1000 + F.when(F.length(f) == 2, f.cast("long") * 10).otherwise(f.cast("long")))


def without_stamps(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, _STAMP, ""))


def synced_lines(text: Column) -> Column:
    """ARRAY<STRUCT<ms, text>> of the lines with a time stamp, in order; empty where there is none."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    timed = F.transform(lines, lambda x: F.struct(stamp_ms(x).alias("ms"), without_stamps(x).alias("text")))
    return F.filter(timed, lambda x: x["ms"].isNotNull())


def header(text: Column, name: str) -> Column:
    """Value of a header line such as [la:en]; null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\[{name}:([^\]]*)\]", 1)), F.lit(""))


def unsynced_text(text: Column) -> Column:
    """The whole trimmed text where no line has a time stamp."""
    return F.when(F.size(synced_lines(text)) == 0, F.trim(text))


def lyrics3_size(tail: Column) -> Column:
    """Size announced in the last 15 characters (six digits and LYRICS200), null where there is none or it is over 102400."""
    n = F.regexp_extract(tail, r"(\d{6})LYRICS200$", 1)
    return F.when((n != "") & (n.cast("int") <= 102400), n.cast("int"))


def lyrics3_field(body: Column, ident: str) -> Column:
    """Text of one [ID][SIZE][DATA] record, the size in five digits."""
    at = F.regexp_instr(body, F.lit(ident + r"\d{5}"))
    size = F.substring(body, at + 3, F.lit(5)).try_cast("int")
    return F.when((at > 0) & size.isNotNull(), F.substring(body, at + 8, size))
