"""Bindings of the operators to the test tables, each next to its oracle SQL."""

from importlib import import_module
from importlib.util import find_spec

SECTIONS = (
    "scans", "scalars", "reshaping", "joining", "aggregating", "windowing", "ordering", "modelling", "checking", "streams",
)


def bindings():
    """All bindings by query name."""
    from biotope.workload.registry import BINDINGS

    for section in SECTIONS:
        name = f"biotope.workload.{section}"
        if find_spec(name):
            import_module(name)
    return BINDINGS
