"""Collecting queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import tune
from ledgerloom.sources.shared import with_local_folder

Query = Callable[[SparkSession, str], DataFrame]


def catalogue() -> tuple[Callable[..., Callable[[Query], Query]], dict[str, Query], dict[str, str]]:
    """A decorator that registers a query under its name, and the two dicts it fills."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(oracle: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            queries[fn.__name__] = lambda spark, sf: fn(with_local_folder(tune(spark)), sf)
            if oracle:
                oracles[fn.__name__] = oracle
            return fn

        return register

    return query, queries, oracles
