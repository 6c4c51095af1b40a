"""Queries of the numbered operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import attribution, decontaminate, langid, linededup, minhash, packing, phrases, quality, suffixes, tokenbin

_MODULES = (langid, quality, packing, tokenbin, attribution, suffixes, linededup, minhash, decontaminate, phrases)


def queries() -> dict[str, Callable]:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
