"""Queries against their SQL on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
CHEAP = "report_rows report_sheets chunks_boundary prompt_texts batch_messages classify_messages prefilter_messages intra_doc_conflicts claim_status_retrieved claims_split numbers_extract entities_quoted entity_noise_filter subclaims keywords_topk attribute_words search_terms status_cascade rrf_fusion adjudication_queue verdict_merge section_numbers advice_text eval_match_documents ab_diff".split()


def plain(value):
    return round(float(value), 6) if isinstance(value, (float, Decimal)) else value


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    sql = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    assert sorted((tuple(map(plain, r)) for r in sql.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr) == rows


def test_every_query_is_named_once():
    names = list(__spark_entry__.queries())
    assert len(names) == len(set(names)) and set(__spark_entry__.oracle_sql()) <= set(names)
