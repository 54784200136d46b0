"""Queries over the star-schema tables, by module; importing a module registers its queries."""

from importlib import import_module

MODULES = ["scans", "verbs", "summaries", "segregation", "permutations", "geometry", "regressions"]


def load() -> tuple[dict, dict]:
    """All queries and their check SQL."""
    for m in MODULES:
        import_module(f"segspark.plans.{m}")
    from segspark.plans.registry import CHECK_SQL, QUERIES

    return dict(QUERIES), dict(CHECK_SQL)
