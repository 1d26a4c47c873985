"""The training-data queries against their SQL on the smallest tables, and those without SQL for their shape."""

import pytest
from oracle import compare

from strandweb.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["page_id_a", "page_id_b"], "p2_found": ["first_raw_id", "raw_id"], "p3_found": ["msg_no"], "p5_found": ["column_name", "term", "mark"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert compare(spark, QUERIES[name], SQL[name], DATA) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    # Not the smallest tables: their dozen graded texts are too few for a reading model.
    assert QUERIES[name](spark, DATA.replace("0.001", "0.01")).count() > 0


def test_columns(spark):
    for name, columns in COLUMNS.items():
        df = QUERIES[name](spark, DATA)
        assert df.columns == columns
        rows = df.collect()
        assert len(set(rows)) == len(rows) and all(None not in tuple(r) for r in rows)
