"""Numbers and texts inside BINARY columns, as Column expressions (positions count from 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(v: int | Column) -> Column:
    return F.lit(v) if isinstance(v, int) else v


def part(b: Column, at: int | Column, n: int | Column) -> Column:
    """Bytes [at, at + n); a negative ``at`` counts from the end."""
    if isinstance(at, int):
        return F.substring(b, F.lit(at + 1 if at >= 0 else at), _lit(n))
    return F.substring(b, at + 1, _lit(n))


def flip(b: Column, n: int) -> Column:
    """The n bytes in reverse order."""
    return F.concat(*[F.substring(b, i, 1) for i in range(n, 0, -1)])


def unsigned(b: Column, n: int) -> Column:
    """Big-endian unsigned integer of n < 8 bytes; null where bytes are missing."""
    return F.when(F.octet_length(b) == n, F.conv(F.hex(b), 16, 10).cast("long"))


def u8(b: Column, at: int | Column) -> Column:
    return unsigned(part(b, at, 1), 1)


def be(b: Column, at: int | Column, n: int) -> Column:
    return unsigned(part(b, at, n), n)


def le(b: Column, at: int | Column, n: int) -> Column:
    return unsigned(flip(part(b, at, n), n), n)


def be64(b: Column, at: int | Column) -> Column:
    """Unsigned 64 bits as DECIMAL(20,0)."""
    p = part(b, at, 8)
    return F.when(F.octet_length(p) == 8, F.conv(F.hex(p), 16, 10).cast("decimal(20,0)"))


def le64(b: Column, at: int | Column) -> Column:
    p = part(b, at, 8)
    return F.when(F.octet_length(p) == 8, F.conv(F.hex(flip(p, 8)), 16, 10).cast("decimal(20,0)"))


def le32_signed(b: Column, at: int | Column) -> Column:
    v = le(b, at, 4)
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def narrow(v: Column) -> Column:
    """A decimal as BIGINT, null where it doesn't fit."""
    return v.try_cast("bigint")


def bits(v: Column, shift: int, width: int) -> Column:
    return F.shiftright(v, shift).bitwiseAND((1 << width) - 1)


def flag(v: Column, bit: int) -> Column:
    return bits(v, bit, 1) == 1


def synchsafe(b: Column, at: int) -> Column:
    """Four bytes of seven bits each."""
    total = F.lit(0).cast("long")
    for i in range(4):
        total = total + F.shiftleft(u8(b, at + i).bitwiseAND(127), 7 * (3 - i))
    return total


def latin1(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def utf8(b: Column) -> Column:
    """UTF-8 with U+FFFD in place of malformed bytes."""
    return F.make_valid_utf8(b.cast("string"))


def utf16(b: Column) -> Column:
    """UTF-16 by its byte order mark, little-endian without one."""
    mark = F.hex(part(b, 0, 2))
    rest = F.substring(b, F.lit(3), F.octet_length(b))
    return F.when(mark == "FEFF", F.decode(rest, "UTF-16BE")).when(mark == "FFFE", F.decode(rest, "UTF-16LE")).otherwise(F.decode(b, "UTF-16LE"))


def until_nul(text: Column) -> Column:
    return F.split_part(text, F.lit("\x00"), F.lit(1))


def field(b: Column, at: int | Column, n: int) -> Column:
    """A fixed-width latin-1 field: cut at the first NUL, trimmed, empty is null."""
    return F.nullif(F.trim(until_nul(latin1(part(b, at, n)))), F.lit(""))


def strip_nul(text: Column) -> Column:
    return F.regexp_replace(text, r"\x00+$", "")


# builders: the inverse, for synthesized inputs


def pack(v: Column, n: int) -> Column:
    """Big-endian bytes of a non-negative integer."""
    return F.unhex(F.lpad(F.hex(v.cast("long")), 2 * n, "0"))


def pack_le(v: Column, n: int) -> Column:
    return flip(pack(v, n), n)


def pad(text: Column, n: int) -> Column:
    """A latin-1 field of n bytes, filled with NUL."""
    raw = F.encode(text, "ISO-8859-1")
    return F.unhex(F.rpad(F.hex(F.substring(raw, 1, n)), 2 * n, "0"))


def raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))
