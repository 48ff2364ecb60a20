"""Collects the job catalogs of every family into one registry."""

from __future__ import annotations

import importlib

_CATALOGS = [
    "weft.plans.catalog_quality",
    "weft.plans.catalog_vectors",
    "weft.plans.catalog_context",
    "weft.plans.catalog_analyze",
    "weft.plans.catalog_render",
    "weft.plans.catalog_pages",
    "weft.plans.catalog_intents",
    "weft.plans.catalog_io",
    "weft.plans.catalog_streams",
]


def _mods():
    return [importlib.import_module(m) for m in _CATALOGS]


def all_queries():
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def all_sql():
    out = {}
    for m in _mods():
        out.update({k: v for k, v in m.SQL.items() if k in m.QUERIES})
    return out
