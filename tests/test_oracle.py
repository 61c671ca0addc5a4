"""Every core query that has an SQL counterpart equals it on whole tables."""

from __future__ import annotations

import pytest

from strataform.plans import registry
from tests.conftest import SMALL
from tests.oracle import connection, differences


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, tmp_path, name):
    assert differences(con, registry.QUERIES[name](spark, SMALL), registry.SQL[name], str(tmp_path / name)) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0
