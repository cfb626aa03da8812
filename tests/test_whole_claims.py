"""The checks take every claim; only the retrieval queries have a query set."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__

from .test_catalog import plain

DATA = Path("/root/testdata/sf0.001")
CHECKS = "match_first snippet_context subclaim_semi subclaim_anti entity_coverage missing_numbers cooccurrence_range growth_context keyword_generality claim_status claim_warnings search_terms".split()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", CHECKS)
def test_every_claim_is_checked(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    sql = __spark_entry__.oracle_sql()[name]
    assert "% 100" not in sql
    df = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in con.sql(sql).select(*(f'"{c}"' for c in columns)).fetchall()), key=repr) == rows
    assert any(r[columns.index("claim_id")] % 100 for r in rows) or not rows
