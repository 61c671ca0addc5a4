from __future__ import annotations

import pytest

from strataform.sources.baseline import BaselineError, delta_documents, load_baselines, parse_deltas, rule_list, severity_gate
from tests.conftest import rows

GOOD = '{"findings": [{"id": "1", "ruleId": "r", "severity": "info", "title": "t", "message": "m", "more": 1}]}'


def frame(spark, *texts):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "source string, text string")


def test_baselines_are_read_strictly(spark):
    assert rows(load_baselines(frame(spark, GOOD, '{"findings": []}'))) == [("s0", "1", "r", "info", "t", "m")]
    for bad in ("{", "[]", "{}", '{"findings": 3}', '{"findings": [{"id": "1"}]}', GOOD.replace('"1"', "1"), None):
        with pytest.raises(BaselineError, match="s1"):
            load_baselines(frame(spark, GOOD, bad)).count()


def test_gate_options():
    assert severity_gate(" Critical ") == "critical" and rule_list(" a, ,b,") == ["a", "b"]
    with pytest.raises(ValueError):
        severity_gate("grave")


def test_deltas_make_the_round_trip(spark):
    df = spark.createDataFrame([("p", "b", "added"), ("p", "a", "removed"), ("q", None, "changed")], "project string, key string, change string")
    docs = delta_documents(df, ["project"])
    assert rows(parse_deltas(docs, spark, "change string, key string").select("project", "key", "change")) == rows(df)
    with pytest.raises(ValueError):
        parse_deltas(spark.createDataFrame([('{"schemaVersion": "9"}',)], "document string"), spark, "key string")
