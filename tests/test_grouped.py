import numpy as np
import pytest

from cadenza.operators.grouped import map_groups
from cadenza.operators.spatial import match, suppress


def _first_and_last(g):
    return (np.array([0]), {"last": np.array([len(g["v"]) - 1]), "n": np.array([len(g["v"])])}) if g["v"][0] >= 0 else None


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_groups_over_many_batches(spark, batch):
    rows = [(None if g == 5 else f"g{g}", 2**60 + v, v - (g == 3)) for g in range(12) for v in range(1 + g * 2 % 9)]
    df = spark.createDataFrame(rows, "g string, big long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {tuple(r) for r in map_groups(df, ["g"], ["v"], _first_and_last, ["g", "big"], "n long", {"last": "big"}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for g, big, v in rows:
        groups.setdefault(g, []).append((v, big))
    assert got == {(g, min(x)[1], max(x)[1], len(x)) for g, x in groups.items() if min(x)[0] >= 0}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g long, id string, x double, s double")
    full = spark.createDataFrame([(1, "a", 0.0, 1.0)], empty.schema)
    assert match(empty, full, ["g"], "id", ["x"], 1.0).collect() == match(full, empty, ["g"], "id", ["x"], 1.0).collect() == []
    assert suppress(empty, ["g"], "id", ["x"], "s", 1.0).collect() == []


def test_large_and_null_keys(spark):
    df = spark.createDataFrame([(1, 2**60 + 1, 0.0, 1.0), (1, None, 50.0, 1.0), (None, 2**60 + 3, 0.0, 1.0)], "g long, id long, x double, s double")
    got = {(r.g, r.left_key, r.right_key) for r in match(df, df, ["g"], "id", ["x"], 1.0).collect()}
    assert got == {(1, 2**60 + 1, 2**60 + 1), (1, None, None), (None, 2**60 + 3, 2**60 + 3)}
