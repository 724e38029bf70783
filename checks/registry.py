"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None, rounded: Sequence[str] = (), digits: int = 6):
    """Register a query; `rounded` names double columns both engines round before comparison."""
    def add(query: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = query(spark, folder)
            return df.withColumns({c: F.expr(f"round(double({c}), {digits})") for c in rounded}) if rounded else df

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            parts = ", ".join(f'round("{c}"::double, {digits}) AS "{c}"' for c in rounded)
            ORACLES[name] = f"SELECT * REPLACE ({parts}) FROM ({sql})" if rounded else sql
        return query
    return add
