"""Catalogue of the depth-frame queries and their SQL."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("forest", "imaging", "clusters", "history", "skeletons", "tracking", "streams")


def _merged(name: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out |= getattr(import_module(f"{__package__}.{family}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
