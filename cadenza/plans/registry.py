"""The registered queries over the driver's tables, and what they share.

Seconds are counted from 2024-01-01 without a time zone. Money is counted in whole cents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return (F.datediff(ts, F.lit("2024-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def cents(x: str) -> Column:
    return F.round(F.col(x) * 100).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds(F.col("ts")).alias("s"))


_S = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)"
_EV = f"ev AS (SELECT event_id, user_id, event_type, value, {_S} AS s FROM events)"
