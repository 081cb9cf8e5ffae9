import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.plans import queries as core

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("repositories", "owners", "repo_nodes", "usernames", "documents", "events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_sql(spark, db, name):
    got = core.QUERIES[name](spark, D).toArrow()
    want = db.sql(core.SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t.column(c).to_pylist() for c in columns))))
    assert rows(got) == rows(want)
    kinds = lambda t: [str(t.schema.field(c).type) for c in columns]
    assert kinds(got) == kinds(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["fetch_id", "nwo", "owner_login", "stars"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.QUERIES) <= set(entry.queries())
