"""Every query of the training-data operators that has SQL agrees with it on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

from corpusloom.llm.oracle import oracle_sql
from corpusloom.llm.queries import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(row):
    return str(tuple(round(x, 9) if isinstance(x, float) else x for x in row))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = Counter(shown(r[c] for c in columns) for r in df.collect())
    result = duck.sql(oracle_sql()[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    assert ours == Counter(shown(x[i] for i in order) for x in result.fetchall())
