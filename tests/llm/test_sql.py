"""The queries against their SQL on the smallest tables, and the repeated calls of those that keep something."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from veritrail.llm import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    return round(float(value), 6) if isinstance(value, (float, Decimal)) else value


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(oracle_sql()) + ["p3_counts"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    sql = con.sql(oracle_sql()[name])
    assert sorted(sql.columns) == columns
    assert sorted((tuple(map(plain, r)) for r in sql.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr) == rows


def test_names_and_sql_agree():
    assert set(oracle_sql()) <= set(queries()) and all(n[0] == "p" and n[1].isdigit() for n in queries())
