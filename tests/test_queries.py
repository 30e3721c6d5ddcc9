"""Every core query against DuckDB on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from quire.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return plain(float(v)) if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_duckdb(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = con.sql(registry.oracle_sql()[name])
    order = [list(rel.columns).index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def test_flagship(spark, sf_dir):
    rows = registry.flagship(spark, sf_dir).collect()
    assert rows and all(r.n_chapters <= 10 and r.text for r in rows)
