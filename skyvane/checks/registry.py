"""Registered queries with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyvane.checks.base_views import BASE
from skyvane.sources.tables import Tables, driver_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# End of the readings in the driver tables, used as the present.
AS_OF = "2024-01-31 00:00:00"
PLACE = "NATION_7"


def register(name: str, query: Query, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = with_base(oracle)


def register_same(name: str, query: Query, other: str) -> None:
    """A query that has to give what ``other`` gives."""
    register(name, query)
    ORACLES[name] = ORACLES[other]


def register_all(entries: dict[str, tuple[Callable[[Tables], DataFrame], str | None]]) -> None:
    """Queries over the four derived tables."""
    for name, (over_tables, oracle) in entries.items():
        register(name, _on_driver_tables(over_tables), oracle)


def with_base(oracle: str) -> str:
    """``SELECT ...`` or ``, more AS (...) SELECT ...`` behind the base views."""
    return f"WITH {BASE} {oracle.strip()}"


def _on_driver_tables(over_tables: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return over_tables(driver_tables(spark, folder))

    return run
