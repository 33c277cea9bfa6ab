"""Registered queries: each has a name, a function of (spark, folder) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


class Registry(dict[str, Entry]):
    """Name → entry; ``@registry.query("name", sql=...)`` registers a function."""

    def query(self, name: str, sql: str | None = None):
        def wrap(f: Query) -> Query:
            if name in self:
                raise ValueError(f"query {name} is registered twice")
            self[name] = Entry(f, sql)
            return f

        return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
