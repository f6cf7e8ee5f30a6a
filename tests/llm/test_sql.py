import glob
import os

import duckdb
import pytest

from lectern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), db.execute(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_text = lambda f: sorted(tuple(map(str, r)) for r in f[columns].itertuples(index=False, name=None))
    assert as_text(got) == as_text(want)
