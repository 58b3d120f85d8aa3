"""Registered queries: each runs a library function over the mapped tables, with SQL to check it."""

from importlib import import_module

_AREAS = ["cleaning", "loading", "spend", "kpi", "reconciling", "pricing", "series", "suppliers", "names", "learning"]


def load():
    """The registry with every area's queries in it."""
    for area in _AREAS:
        import_module(f"tendermill.catalog.{area}")
    from tendermill.catalog.registry import REGISTRY

    return REGISTRY
