"""The registry of queries: each applies an operator to layers of the tables, with SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.sources.views import Layers, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, lists: tuple[str, ...] = ()):
    """Registers a function of Layers under this name. lists: array columns, which the query gives as text with bars, as
    engines differ in how they print and hash arrays."""

    def put(f: Callable[[Layers], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Layers(spark, sf_dir))
            return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in lists}) if lists else df

        QUERIES[name] = run
        if sql:
            told = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in lists)
            SQL[name] = f"SELECT * REPLACE ({told}) FROM ({with_views(sql)})" if lists else with_views(sql)
        return f

    return put
