"""Every query against its SQL; those without SQL are tested with their operators."""

import pytest
from cadenza.plans import driver_queries, score_queries  # noqa: F401
from cadenza.plans.registry import ORACLES, QUERIES

from .conftest import SF, canonical, views


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        con = views(SF)
        names = [c[0] for c in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()]
        assert sorted(names) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(con.execute(ORACLES[name]).fetchall(), names)
