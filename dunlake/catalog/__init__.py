"""Named queries over the star-schema tables, each with its SQL twin."""

from importlib import import_module

MODULES = (
    "classifications",
    "scalars",
    "filters",
    "rows",
    "relations",
    "aggregations",
    "files",
    "jobs",
)


def load_all() -> None:
    """Import every module that registers queries."""
    for module in MODULES:
        import_module(f"dunlake.catalog.{module}")
