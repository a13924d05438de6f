"""Registered queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from . import compared, detectors, gaps, learned, profile, tables

MODULES = (tables, gaps, profile, detectors, compared, learned)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
