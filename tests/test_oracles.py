"""Every query with an oracle against DuckDB; the others must give rows."""

import glob
import os
import math

import pytest

from __spark_entry__ import oracle_sql, queries

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in queries() if not n.startswith("op") and n != "pipeline"]
EMPTY = {"filter_matches"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple(str(x) for x in r))


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.skipif(not glob.glob(f"{DATA}/orders.parquet"), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    import duckdb

    df = queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    assert got or name in EMPTY
    if name in oracle_sql():
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        rel = con.execute(oracle_sql()[name])
        names = [c[0] for c in rel.description]
        assert sorted(names) == sorted(df.columns)
        want = rows(names, rel.fetchall())
        assert len(got) == len(want)
        bad = [(a, b) for a, b in zip(got, want, strict=True) if not all(map(close, a, b))]
        assert not bad, bad[:3]
