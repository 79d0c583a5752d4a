"""The problems' queries on given, dirty and empty tables."""

import pytest
from millrace.llm import queries as Q
from tables import GIVEN, comparable, dirty, empty, sql_rows

pytestmark = pytest.mark.skipif(not GIVEN.exists(), reason="needs the given tables")
COLUMNS = {
    "p1_found": ["id_a", "id_b"], "p2_found": ["fetch_id", "line_no"], "p3_found": ["conversation_id", "defect"], "p4_found": ["tbl", "row_id", "pii_type", "found_text"], "p5_found": ["tbl", "key_a", "key_b"],
    "p6_found": ["chunk_id"], "p7_found": ["tbl", "id", "defect"], "p10_found": ["doc_id", "reading_level"],
}


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    return str(dirty(tmp_path_factory.mktemp("dirty"))), str(empty(tmp_path_factory.mktemp("empty")))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_dirty_and_empty_tables(spark, folders, name):
    whole, none = folders
    df = Q.queries()[name](spark, whole)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows)
        assert all(v is not None for r in rows for v in r)
    left = Q.queries()[name](spark, none).collect()
    assert all("actual_share" in r.asDict() for r in left)  # only a report of targets has rows then


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    df = Q.queries()[name](spark, str(GIVEN))
    columns, wanted = sql_rows(GIVEN, Q.oracle_sql()[name])
    order = [columns.index(c) for c in df.columns]
    assert sorted(tuple(comparable(v) for v in r) for r in df.collect()) == sorted(tuple(comparable(r[i]) for i in order) for r in wanted)
