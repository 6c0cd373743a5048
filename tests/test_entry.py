"""The registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
SOME = ["t2_tokenize", "t9_typo_vector", "t15_chunks", "a7_richness", "j6_top_combined", "s3_signature", "s5_charsets", "r9_scores_self", "x4_eval"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def norm(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, duck, name):
    rows = entry.queries()[name](spark, str(DATA))
    columns = sorted(rows.columns)
    got = sorted(tuple(map(norm, r)) for r in rows.select(*columns).collect())
    sql = duck.sql(entry.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    want = sorted(tuple(map(norm, r)) for r in sql.select(*columns).fetchall()) if hasattr(sql, "select") else None
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
