"""Every registered query of the reference's operators against its SQL on another engine."""

import duckdb
import numpy as np
import pytest

from pricewright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def other(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind in "iufb" or str(frame[c].dtype) in ("Int64", "boolean"):
            frame[c] = frame[c].astype("float64").round(8)
        else:
            frame[c] = frame[c].map(lambda x: None if x is None or (isinstance(x, float) and np.isnan(x)) else str(x)).astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, other, name):
    got, want = rows(registry.queries()[name](spark, sf_dir).toPandas()), rows(other.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert got.equals(want), got[(got != want).any(axis=1)].head()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
