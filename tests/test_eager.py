from __future__ import annotations

import random

from strataform.operators.eager import eager_join, key_states
from tests.conftest import rows

SCHEMA = "key string, row_id bigint, measure double, at timestamp"


def frame(spark, data):
    from datetime import datetime

    return spark.createDataFrame([(k, i, m, None if t is None else datetime.fromtimestamp(t)) for k, i, m, t in data], SCHEMA)


def best(data, k=3):
    by = {}
    for key, i, m, t in {d for d in data if d[0] is not None and d[1] is not None}:
        by.setdefault(key, []).append((m is None, -(m or 0), t is None, -(t or 0), i))
    return {key: [x[-1] for x in sorted(v)][:k] for key, v in by.items()}


def test_best_rows_with_ties_nulls_and_repeats(spark):
    rnd = random.Random(3)
    data = []
    for i in range(400):
        key = rnd.choice(["hot"] * 6 + ["a", "b", "c", None])
        data.append((key, i, rnd.choice([0.5, 0.7, None]), rnd.choice([10, 20, None])))
    data += data[:100]
    got = {r.key: [x.row_id for x in r.best] for r in key_states(frame(spark, data), 3).collect()}
    assert got == best(data)


def test_counts_multiply(spark):
    left = [("x", 1, 0.5, 1), ("x", 2, 0.25, 1), ("x", 2, 0.25, 1), ("y", 3, None, 1)]
    right = [("x", 7, 2.0, 1), ("x", 8, None, 1), ("z", 9, 1.0, 1)]
    got = {r.key: r for r in eager_join(frame(spark, left), frame(spark, right)).collect()}
    assert (got["x"].pairs, got["x"].measured_pairs, float(got["x"].total_product)) == (4, 2, 1.5)
    assert (got["y"].pairs, got["z"].pairs, got["y"].right_best) == (0, 0, None)
    assert [b.row_id for b in got["x"].left_best] == [1, 2]


def test_nan_is_null_and_empty_inputs_give_nothing(spark):
    data = frame(spark, [("x", 1, float("nan"), 1), ("x", 2, 0.1, None)])
    state = key_states(data, 3).first()
    assert (state.n, state.n_measured, [b.row_id for b in state.best]) == (2, 1, [2, 1])
    nothing = frame(spark, [])
    assert rows(eager_join(nothing, nothing)) == []
    assert eager_join(data, nothing).first().right_n == 0
