"""All queries of the engine by name, with their DuckDB oracles."""

from . import exports  # noqa: F401  (registers its queries)
from .queries import ORACLES, QUERIES
from .views import oracle


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return {name: oracle(text) for name, text in ORACLES.items()}
