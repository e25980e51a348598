"""Scalar normalizers that follow the tag mapping, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_value(v_str: Column, v_list: Column, v_int: Column | None = None, v_bool: Column | None = None) -> Column:
    """One text: the string as it is, else the first non-empty entry of the list, else the number or flag as text."""
    more = [x.cast("string") for x in (v_int, v_bool) if x is not None]
    return F.coalesce(v_str, F.try_element_at(F.filter(v_list, lambda x: x != ""), F.lit(1)), *more)


def value_list(v_str: Column, v_list: Column, v_int: Column | None = None, v_bool: Column | None = None) -> Column:
    """All texts: a scalar becomes one entry, empty entries of a list are dropped, nothing left is null."""
    scalar = F.coalesce(v_str, *[x.cast("string") for x in (v_int, v_bool) if x is not None])
    listed = F.filter(v_list, lambda x: x != "")
    return F.when(F.size(listed) > 0, listed).when(scalar.isNotNull(), F.array(scalar))


def non_empty(values: Column) -> Column:
    """Trimmed entries without the empty ones."""
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")


def whole_int(text: Column) -> Column:
    """The integer a text consists of, else null."""
    return F.trim(text).try_cast("int")


def leading_int(text: Column) -> Column:
    """The integer before a slash."""
    return F.split_part(F.trim(text), F.lit("/"), F.lit(1)).try_cast("int")


def position(text: Column) -> Column:
    return leading_int(text)


def total(text: Column, zero_is_none: bool = False) -> Column:
    """The integer after a slash; null without one. MP4 totals of 0 mean none."""
    n = F.try_element_at(F.split(F.trim(text), "/", 2), F.lit(2)).try_cast("int")
    return F.nullif(n, F.lit(0)) if zero_is_none else n


def to_bool(text: Column) -> Column:
    """1/true/yes and 0/false/no in any case; others are null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes"), True).when(t.isin("0", "false", "no"), False)


def number_to_bool(value: Column) -> Column:
    return value.try_cast("double") > 0


def nonzero(text: Column) -> Column:
    return whole_int(text) != 0


def rating(value: Column, low: float | None = None, high: float | None = None, scale: float = 100.0) -> Column:
    """A rating as a share; ASF clamps the share to 0..1, RIFF the number to 0..100."""
    v = value.cast("double")
    if low is not None and high is not None:
        v = F.least(F.greatest(v, F.lit(low)), F.lit(high))
    return v / scale


def stars(share: Column) -> Column:
    """1 to 5 stars of a rating from 0 to 1; null stays null."""
    return F.when(share.isNotNull(), F.least(F.greatest(F.round(share * 4 + 1), F.lit(1)), F.lit(5)).cast("int"))


def year_of(date: Column) -> Column:
    """The year a date text begins with; texts under four characters have none."""
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4).try_cast("int"))


def cover_type(key: Column) -> Column:
    return F.when(F.lower(key) == "cover art (front)", "Cover (front)").when(F.lower(key) == "cover art (back)", "Cover (back)")


def comment_struct(text: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("descriptor"), F.lit(None).cast("string").alias("language"), text.alias("text"))
