"""Registered queries with their check SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("describe_tables", "clean_profile", "segments", "sequences", "spending")


def _collect(attr: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out.update(getattr(import_module(f"{__name__}.{name}"), attr))
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLE")


QUERY_MODULE = {
    name: module for module in _MODULES for name in import_module(f"{__name__}.{module}").QUERIES
}
