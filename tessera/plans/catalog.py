"""All queries of the core and their SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib

#: Plan modules; each has QUERIES and SQL.
MODULES = ("problems", "temporal", "relational", "evidence", "retrieval", "graph", "text", "streaming", "readmodels", "assembly", "listings", "reports")
FLAGSHIP = "hybrid_documents"


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"tessera.plans.{name}"), attribute)
        if twice := out.keys() & part.keys():
            raise ValueError(f"named twice: {sorted(twice)}")
        out |= part
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
