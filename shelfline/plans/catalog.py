"""All registered queries.  Importing the catalogue modules registers them."""

from __future__ import annotations

from shelfline.plans import (  # noqa: F401
    catalog_features,
    catalog_profile,
    catalog_quality,
    catalog_backtest,
    catalog_inventory,
    catalog_decision,
    catalog_sources,
    catalog_models,
)
from shelfline.plans.registry import CATALOG


def queries():
    return {key: q.run for key, q in CATALOG.items()}


def oracle_sql():
    return {key: q.sql for key, q in CATALOG.items() if q.sql}


def coverage():
    """Inventory row -> queries that implement it."""
    rows: dict[str, list[str]] = {}
    for key, q in CATALOG.items():
        for item in q.covers:
            rows.setdefault(item, []).append(key)
    return rows
