"""Every registered query against its DuckDB oracle at the smallest scale
(the same compare as the correctness gate: row count, columns, value hash)."""

import sys

import duckdb
import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from graphwright.sources.tables import TABLES  # noqa: E402
from tools.check_oracle import digest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, key):
    df = queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(oracle_sql()[key])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]


@pytest.mark.parametrize("key", sorted(set(queries()) - set(oracle_sql())))
def test_rows_only_queries_run(spark, key):
    assert queries()[key](spark, SF).count() >= 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["s", "p", "o", "o_kind", "lang"] and df.count() > 0
