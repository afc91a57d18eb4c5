"""Every registered query of the storage engine, with its SQL oracle where SQL can express it."""

from __future__ import annotations

from blockloom.plans import relational, storage, stored

MODULES: tuple = (relational, storage, stored)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
