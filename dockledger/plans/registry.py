"""Registry of the named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ops: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(ops: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a function under its own name; ``ops`` lists the operators it covers."""
    def add(build: Build) -> Build:
        REGISTRY[build.__name__] = Query(build.__name__, ops, build, sql)
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
