"""The operators bound to the shared test tables, each with its SQL counterpart."""

from importlib import import_module

from tablewright.plans.registry import ORACLES, QUERIES

SECTIONS = ("scans", "joins", "aggregates", "scalars", "documents", "hierarchies", "changes")

for _section in SECTIONS:
    import_module(f"tablewright.plans.{_section}")

__all__ = ["ORACLES", "QUERIES"]
