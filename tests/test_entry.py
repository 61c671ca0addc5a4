from __future__ import annotations

import sys

import __spark_entry__ as e


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["snapshot_id", "claim_id", "change_kind"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_text_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "strataform.llm", None)
    monkeypatch.setitem(sys.modules, "strataform.llm.queries", None)
    names = e.queries()
    assert "p1_found" in names and not any(n.startswith(("p6", "p7", "p8")) for n in names)
