import duckdb
import pytest

from churnscope.llm import queries
from tests.llm.helpers import SF_CHECK


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_CHECK}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF_CHECK)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
