from __future__ import annotations

import __spark_entry__
from strataform.llm import queries
from tests.conftest import SMALL
from tests.oracle import connection, differences


def test_sql_counterparts(spark, tmp_path):
    con = connection(SMALL)
    for name, sql in queries.SQL.items():
        assert differences(con, queries.QUERIES[name](spark, SMALL), sql, str(tmp_path / name)) == [], name


def test_columns(spark):
    want = {"p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "pii_type", "found_value"]}
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, SMALL)
        assert df.columns == columns and df.count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
