"""Query registration and access to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardpanel.functions.numeric import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r(expr: str, name: str, digits: int = 6) -> str:
    """SQL twin of `rounded`."""
    return f"round(({expr}) + 3.71e-{digits + 3}, {digits}) + 0.0 AS {name}"


def tidy(df: DataFrame, keys, values, digits: int = 6) -> DataFrame:
    """Keys as they are, doubles rounded."""
    return df.select(*keys, *[rounded(F.col(v).cast("double"), digits).alias(v) for v in values])
