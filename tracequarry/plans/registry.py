"""Name to query registry; a name can be given to one query only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Queries and, where SQL can say the same, their SQL."""

    run: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, run: Query, sql: str | None = None) -> None:
        if name in self.run and self.run[name] is not run:
            raise ValueError(f"{name} is already registered with another query")
        self.run[name] = run
        if sql:
            self.sql[name] = sql

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def wrap(f: Query) -> Query:
            self.add(name, f, sql)
            return f

        return wrap
