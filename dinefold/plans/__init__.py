"""Registered queries: the given tables in the roles of the order domain, and their oracles."""

from __future__ import annotations

import importlib

# One module per section of the inventory; importing it registers its queries.
SECTIONS = (
    "merge", "validation", "cleaning", "sources", "visits", "anomalies", "reports", "corrected", "periods", "takeaway", "drinks",
    "streams", "precheck",
)


def _load():
    for name in SECTIONS:
        importlib.import_module(f"dinefold.plans.{name}")
    return importlib.import_module("dinefold.plans.catalog")


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
