"""All queries of the package and the SQL that states their results."""

from __future__ import annotations

from tagloom.plans import decode, formats, planning, resolve, training

_MODULES = [training, resolve, formats, planning, decode]


def queries() -> dict:
    found: dict = {}
    for m in _MODULES:
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _MODULES:
        found |= m.ORACLE
    return found
