"""Every query of the catalogue against its SQL, over the smallest test tables."""

from pathlib import Path

import duckdb
import pytest

from contigua import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql(f"create view documents as from '{SF}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query_equals_its_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    got = df.toPandas()
    want = con.sql(catalogue.oracles()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert {c: str(got[c].dtype) for c in columns} == {c: str(want[c].dtype) for c in columns}
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in columns:
        assert (a[c].eq(b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracles())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
