"""Named queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "rules_and_trust",
    "texts",
    "statistics",
    "audit_trail",
    "knowledge",
    "legal",
    "models",
    "reports",
)


def _modules():
    return [import_module(f"govlattice.catalog.{m}") for m in MODULES]


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracles() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
