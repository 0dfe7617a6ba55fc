"""A local session and DuckDB views for the tests."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{folder}").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def views(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(rows, names):
    """Rows as text, columns by name, in any order."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(str(r[k]) for k in order) for r in rows)
