"""Every plan gives the same rows in Spark as in DuckDB on the smallest tables."""

import duckdb
import pytest

from pagewright.operators import PLANS, oracle, run

DATA = "/root/testdata/sf0.001"


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan(spark, duck, name):
    table = "pages" if name == "html_blocks" else "documents"
    df = run(name, spark.read.parquet(f"{DATA}/{table}.parquet"), table)
    want = duck.sql(oracle(name))
    assert sorted(df.columns) == sorted(want.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), want.columns)
