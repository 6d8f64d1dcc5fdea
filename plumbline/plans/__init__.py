"""Queries over the available tables, one module per subject area."""

from importlib import import_module

from .registry import CHECKS, QUERIES, query

AREAS = ("telemetry", "streams", "finops", "registry_access", "duplicates", "manifests", "sql_corpus",
         "code_structure", "code_calls", "code_decisions", "code_tree", "policy", "observability")

for _area in AREAS:
    import_module(f"{__name__}.{_area}")

__all__ = ["CHECKS", "QUERIES", "query"]
