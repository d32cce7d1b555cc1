"""Every core query with SQL agrees with it on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

from corpusloom.plans.oracle import oracle_sql
from corpusloom.plans.queries import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = Counter(str(tuple(r[c] for c in columns)) for r in df.collect())
    assert ours
    if name in oracle_sql():
        result = duck.sql(oracle_sql()[name])
        assert sorted(result.columns) == columns
        order = [result.columns.index(c) for c in columns]
        assert ours == Counter(str(tuple(x[i] for i in order)) for x in result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
