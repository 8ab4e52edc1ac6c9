"""Every operator as a query over the test tables, with its SQL where one exists."""

from __future__ import annotations

from importlib import import_module

from stratanet.catalog.base import REGISTRY

for _module in ("tables", "panels", "measures", "graphs", "windows", "curves", "communities", "residuals"):
    import_module(f"stratanet.catalog.{_module}")


def queries():
    return {name: fn for name, (fn, _sql) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_fn, sql) in REGISTRY.items() if sql is not None}
