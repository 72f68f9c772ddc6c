"""Names, SQL texts, and the operators that SQL can state on the smallest tables."""

import glob
import os

import duckdb
import pytest

from kinlattice.llm import queries

SF = "/root/testdata/sf0.001"


def test_names_and_sql():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert all(isinstance(v, str) for v in queries.ORACLES.values()) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for path in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        want = con.execute(queries.ORACLES[name]).df()
        columns = sorted(got.columns)
        text = lambda frame: sorted(tuple(map(str, r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())
        assert columns == sorted(want.columns) and text(got) == text(want)
