"""Every core query beside its SQL on the smallest tables."""

import os

import duckdb
import pytest

from strataline.plans import registry
from tools.verify import canon

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted("|".join(canon(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted("|".join(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    registry.queries()[name](spark, DATA).collect()
