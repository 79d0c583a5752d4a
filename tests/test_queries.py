"""Every core query against its SQL, on given tables; and all of them on dirty and empty ones."""

import pytest
from millrace import queries as Q
from tables import GIVEN, comparable, dirty, empty, sql_rows

pytestmark = pytest.mark.skipif(not GIVEN.exists(), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, name):
    df = Q.QUERIES[name](spark, str(GIVEN))
    columns, wanted = sql_rows(GIVEN, Q.SQL[name])
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in df.columns]
    got = sorted((tuple(comparable(v) for v in r) for r in df.collect()), key=str)
    assert got == sorted((tuple(comparable(r[i]) for i in order) for r in wanted), key=str)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    return str(dirty(tmp_path_factory.mktemp("dirty"))), str(empty(tmp_path_factory.mktemp("empty")))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_dirty_and_empty_tables(spark, folders, name):
    whole, none = folders
    Q.QUERIES[name](spark, whole).collect()
    rows = Q.QUERIES[name](spark, none).collect()
    # Totals have one row, counts of queries none; nothing else comes from empty tables.
    assert len(rows) <= 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
