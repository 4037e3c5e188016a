"""Where the queries of the package are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bridge import sql as with_tables
from .bridge import table

Query = Callable[[SparkSession, str], DataFrame]


class Queries:
    """Queries by name, each a function of the tables it names, and SQL for those that have it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, tables: str, build: Callable[..., DataFrame], sql: str | None = None) -> None:
        """tables: names, parted by spaces; build gets them in this order."""
        self.queries[name] = lambda spark, sf_dir: build(*[table(spark, sf_dir, t) for t in tables.split()])
        if sql is not None:
            self.sql[name] = with_tables(sql)
