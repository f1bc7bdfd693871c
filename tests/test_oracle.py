"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewater.plans import registry, suites  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(p: pd.DataFrame) -> list[tuple]:
    p = p[sorted(p.columns)].copy()
    for k in p:
        if str(p[k].dtype).startswith("datetime"):
            p[k] = p[k].astype("datetime64[us]").astype(str)
        elif p[k].dtype == object:
            p[k] = p[k].map(lambda x: "~" if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) else str(x))
        else:
            p[k] = p[k].astype(float).map(lambda x: "~" if np.isnan(x) else repr(x + 0.0))
    return sorted(map(tuple, p.values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(found.columns) > 0
        return
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)
