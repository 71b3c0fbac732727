"""The registered queries: name, query, and its DuckDB counterpart where SQL can express it."""

from tallgrass.plans import analytics, detection, streams

_REGISTRIES = (detection.registry, analytics.registry, streams.registry)


def all_queries() -> dict:
    return {name: f for r in _REGISTRIES for name, f in r.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for r in _REGISTRIES for name, sql in r.sql.items()}
