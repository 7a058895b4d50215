"""Each query beside its SQL in a second engine, over the small tables."""

import duckdb
import pytest

from docloom.plans.oracles import ORACLES
from docloom.plans.queries import Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sql, name):
    assert rows(Q[name](spark, DATA).toPandas()) == rows(sql.execute(ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(Q) - set(ORACLES)))
def test_runs(spark, name):
    assert Q[name](spark, DATA).count() > 0


def test_imports_without_a_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True, cwd=__file__.rsplit("/tests/", 1)[0], timeout=120)
