"""All queries over the driver tables and their SQL twins."""

from __future__ import annotations

from .registry import ORACLE, QUERIES


def _load() -> None:
    from . import abstracts, audit, compare, corpus, drift, forms, instruments, linked, reports, senses, sensitivity, vectors  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
