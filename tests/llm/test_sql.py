"""The queries that SQL can say, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from blockloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(tuple("null" if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in d[columns].astype(object).itertuples(index=False))
    clean = lambda rs: [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in rs]
    assert clean(rows(got)) == clean(rows(want))
