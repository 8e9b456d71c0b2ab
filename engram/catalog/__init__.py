"""Registered queries, their fixtures and their DuckDB SQL."""


def load():
    import importlib
    import pkgutil

    from engram.catalog.registry import QUERIES

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"engram.catalog.{module}")
    return dict(QUERIES)
