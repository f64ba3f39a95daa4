"""All core queries and their SQL."""

from __future__ import annotations

from docweave.plans import core, ingest, reporting, search, textual

MODULES = [core, reporting, textual, search, ingest]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
