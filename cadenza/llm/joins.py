"""Joins whose large side may have one key in a third of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which on it is joined by a broadcast: a table of N rows has at most N / HOT such keys.
HOT = 1 << 16


def join_counted(large: DataFrame, small: DataFrame, on: str, count: str, hot: int = HOT) -> DataFrame:
    """Inner join with a table that has each key once, and in `count` about how many rows of the large one have it.

    Keys with `hot` rows or more are at most one in `hot` rows of the large table, so broadcasting them takes
    a bounded share of its size; the rest have few rows each and are joined by a shuffle.
    """
    frequent = small.where(F.col(count) >= hot).drop(count)
    if frequent.isEmpty():
        return large.join(small.drop(count), on)
    frequent = F.broadcast(frequent)
    rest = large.join(frequent.select(on), on, "left_anti")
    return large.join(frequent, on).unionByName(rest.join(small.where(F.col(count) < hot).drop(count), on))
