"""Registry of named queries and the check SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skytally.operators.ordered import drop_slices, split_hot_keys

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query with the SQL that must give the same rows."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: drop_slices(function(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str, *keysets) -> DataFrame:
    """The events table, with the hot keys of the given key sets cut into slices."""
    rows = table(spark, folder, "events").drop("props")
    return split_hot_keys(rows, [list(k) for k in keysets], ["ts", "event_id"], rows=rows.count()) if keysets else rows
