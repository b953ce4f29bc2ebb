"""The training-data queries against their SQL where there is one; the others must run on whole tables."""

import pytest

from docloom.llm import queries

QUERIES, SQL = queries.queries(), queries.sql()
COLUMNS = {
    "p1_found": ["change_id", "field_name"], "p2_found": ["change_id", "line_no"], "p4_found": ["src_table", "row_id"], "p5_found": ["vec_a", "vec_b"],
    "p6_found": ["id_a", "id_b"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "start_at", "end_at"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, compare, spark, data):
    if name in SQL:
        compare(QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_no_repeats(name, spark, data):
    found = QUERIES[name](spark, data)
    assert found.columns == COLUMNS[name]
    rows = [tuple(map(str, r)) for r in found.collect()]
    assert len(rows) == len(set(rows)) > 0
