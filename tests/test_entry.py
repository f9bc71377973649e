import glob
import os

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

import __spark_entry__ as entry

Q, SQL = entry.queries(), entry.oracle_sql()


def rows(df: pd.DataFrame) -> list[str]:
    def plain(x):
        if not isinstance(x, list) and pd.isna(x):
            return "-"
        return f"{float(x):.6g}" if isinstance(x, float) or "Decimal" in str(type(x)) else str(int(x)) if "int" in str(type(x)) else str(x)

    return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in SQL if n in Q])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = Q[name](spark, SMALL).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
