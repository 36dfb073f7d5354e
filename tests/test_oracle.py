"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables where they are present."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from graphloom import catalog_queries, queries, source_queries  # noqa: F401 (they register their queries)

SF = Path("/root/testdata/sf0.001")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    text = lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or x != x else str(pd.Timestamp(x)) if isinstance(x, pd.Timestamp) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return list(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.skipif(not SF.exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, str(SF)).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got)
        return
    with duckdb.connect() as db:
        for f in SF.glob("*.parquet"):
            db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        assert rows(got) == rows(db.execute(queries.ORACLE_SQL[name]).df())
