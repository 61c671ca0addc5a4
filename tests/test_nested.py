from __future__ import annotations

import json

from strataform.operators.nested import BRAIN, flat_items, flat_table, snake
from tests.conftest import rows


def brute(payload):
    """A plain walk over the parsed document."""
    try:
        v = json.loads(payload) if payload is not None else None
    except ValueError:
        return []
    brain = v.get("brain") if isinstance(v, dict) and isinstance(v.get("brain"), dict) else v
    if not isinstance(brain, dict):
        return []
    model = brain.get("model")
    if isinstance(model, str):
        try:
            model = json.loads(model)
        except ValueError:
            model = None
    many = lambda x: [] if x is None else x if isinstance(x, list) else [x]
    out = []
    for e in BRAIN:
        root = brain if e.root == "brain" else model if isinstance(model, dict) else {}
        for i, r in enumerate(many(root.get(e.camel))):
            if r is None:
                continue
            get = lambda n, r=r: (r.get(n) if r.get(n) is not None else r.get(snake(n))) if isinstance(r, dict) else None
            out.append((e.entity, -1, i, "" if get("id") is None else str(get("id"))))
            for c in e.children:
                out += [(c.entity, i, j, str(x)) for j, x in enumerate(many(get(c.camel))) if x is not None]
    return sorted(out, key=repr)


CASES = [
    None,
    "",
    "{",
    "[]",
    "3",
    '"text"',
    "{}",
    *['{"claims": [{"id": "c"}]}' + x for x in ("x", "]", "}", " {}", ", {}", "\x00", "] y", ' , "z": 1', " \n")],
    '{"claims": [{"id": "a", "id": "b"}], "claims": {"id": "z"}}',
    '{"claims": [{"id": 01}]}',
    json.dumps({"brain": None, "claims": [{"id": "c"}]}),
    json.dumps({"claims": [None, {"id": None, "evidenceIds": "e1"}, {"evidence_ids": [None, "e2", ""]}, "odd", 7]}),
    json.dumps({"brain": {"claims": {"id": "only", "contradictionIds": [None]}, "model": None, "evidence": []}, "x": [1]}),
    json.dumps({"model": json.dumps({"domains": [{"id": "d", "paths": ["p", None, "q"]}]}), "components": [{"id": 12, "dependencyIds": ["a"], "evidence_ids": None}]}),
    json.dumps({"model": "not json", "evidence": [{"id": "é\u0000x"}]}),
    json.dumps({"model": {"architectures": {"matched_rules": "one"}, "dependencies": [{"evidence": ["y" * 100_000]}], "relationships": None, "entrypoints": [None, None]}}),
]


def test_flat_items_equal_a_plain_walk(spark):
    df = spark.createDataFrame([(i, c, "x") for i, c in enumerate(CASES)], "export_id bigint, payload string, entity string")
    got = {}
    for k, *row in flat_items(df, "export_id").collect():
        got.setdefault(k, []).append(tuple(row))
    for i, c in enumerate(CASES):
        assert sorted(got.get(i, []), key=repr) == brute(c), c


def test_empty_table_and_flat_table(spark):
    empty = spark.createDataFrame([], "export_id bigint, payload string")
    assert rows(flat_items(empty, "export_id")) == []
    one = spark.createDataFrame([(1, CASES[-3])], "export_id bigint, payload string")
    assert rows(flat_table(one, "export_id", "component", {"id": "id", "path": "path"})) == [(1, 0, "12", None)]
