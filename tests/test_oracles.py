"""Every query with an oracle agrees with DuckDB at sf0.001 (the driver's check runs at sf0.01)."""

import math

import duckdb
import pytest

from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _keys():
    import __spark_entry__ as ent
    return sorted(ent.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, con, key):
    import __spark_entry__ as ent
    sdf = ent.queries()[key](spark, SF_SMALL)
    rel = con.sql(ent.oracle_sql()[key])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = sorted(sdf.columns)
    s_rows = sorted((tuple(_norm(r[c]) for c in order) for r in sdf.collect()), key=repr)
    d_idx = [rel.columns.index(c) for c in order]
    d_rows = sorted((tuple(_norm(r[i]) for i in d_idx) for r in rel.fetchall()), key=repr)
    assert s_rows == d_rows


def test_every_query_key_is_registered(spark):
    import __spark_entry__ as ent
    assert set(ent.oracle_sql()) <= set(ent.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as ent
    df = ent.entry(spark)
    assert df.count() > 0 and "kappa" in df.columns
