"""What the registered queries share: tables, and the DuckDB form of the event input."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallgrass.sources.events import from_table

Query = Callable[[SparkSession, str], DataFrame]

#: The events as every query reads them.
EV = """ev AS (SELECT event_id, ts, epoch_us(ts) // 1000 AS ts_ms, user_id, user_id % 3 AS tenant_id, event_type, value,
  json_extract_string(props, '$.k') AS k FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark, sf_dir)


class Registry:
    """Queries by name, and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql if "ev AS (" in sql or not re.search(r"\bev\b", sql) else f"WITH {EV} {sql}"
            return f

        return register
