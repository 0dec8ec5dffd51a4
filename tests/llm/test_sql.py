"""The numbered queries that SQL can express, against DuckDB."""

import glob
import math
import os

import pytest

from seriesforge.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not glob.glob(f"{DATA}/documents.parquet"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_like_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(rows, key=lambda r: tuple(map(str, r)))
    plain = lambda rows: key([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows])
    got, want = plain(df.select(*names).collect()), plain(rel.fetchall())
    assert len(got) == len(want)
    assert all(all(math.isclose(x, y, abs_tol=2e-9) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True)) for a, b in zip(got, want, strict=True))
