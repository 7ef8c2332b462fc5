"""Named query plans over the driver tables (Spark builders + DuckDB oracles)."""

import importlib

_MODULES = ("flagship", "relational", "cleanup", "catalog", "retrieval", "training", "io", "scoring")


def load_all():
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
    from . import registry
    return registry
