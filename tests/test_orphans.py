from __future__ import annotations

import random

from pyspark.sql import functions as F

from strataform.operators.orphans import hot_keys, keyed, orphan_keys
from strataform.operators.skew import join_hot
from tests.conftest import rows

SCHEMA = "scope string, at int, key string"


def run(spark, refs, parents, buckets=2):
    r, p = spark.createDataFrame(refs, SCHEMA), spark.createDataFrame(parents, SCHEMA)
    return rows(orphans(r, p, buckets))


def orphans(r, p, buckets):
    return orphan_keys(keyed(r, p, ["scope"], "at", "key", F.lit(buckets)), ["scope"], "at", "key")


def brute(refs, parents):
    held = {}
    for s, a, k in parents:
        if None not in (s, a, k):
            held.setdefault((s, k), set()).add(a)
    out = set()
    for s, a, k in refs:
        if None in (s, a, k) or a in held.get((s, k), ()):
            continue
        ats = held.get((s, k))
        out.add((s, a, k, min(ats) if ats else None, max(ats) if ats else None))
    return sorted(out, key=repr)


def test_runs_equal_brute_force(spark):
    rnd = random.Random(7)
    pick = lambda n: [(rnd.choice("ab"), rnd.randint(1, 4), f"k{rnd.randint(0, 40):02d}") for _ in range(n)]
    refs, parents = pick(300), pick(250)
    for buckets in (1, 3):
        assert run(spark, refs, parents, buckets) == brute(refs, parents)


def test_nulls_repeats_and_empty_tables(spark):
    parents = [("a", 1, "x"), ("a", 1, "x"), (None, 1, "y"), ("a", None, "y"), ("a", 1, None)]
    refs = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), (None, 1, "x"), ("a", 2, "x"), ("a", 1, None)]
    assert run(spark, refs, parents) == [("a", 1, "y", None, None), ("a", 2, "x", 1, 1)]
    assert run(spark, refs, []) == [("a", 1, "x", None, None), ("a", 1, "y", None, None), ("a", 2, "x", None, None)]
    assert run(spark, [], parents) == []


def test_scopes_do_not_mix_and_extra_columns_do_not_clash(spark):
    r = spark.createDataFrame([("a", 1, "x", 9)], SCHEMA + ", first_at int")
    p = spark.createDataFrame([("b", 1, "x", 9)], SCHEMA + ", __ord int")
    assert rows(orphans(r, p, 1)) == [("a", 1, "x", None, None)]


def test_verdicts_meet_hot_references_over_salts(spark):
    refs = spark.createDataFrame([("a", 1, "gone", i) for i in range(50)] + [("a", 1, "x", 50), ("a", 1, "lost", 51)], SCHEMA + ", claim int")
    parents = spark.createDataFrame([("a", 1, "x")], SCHEMA)
    keys = keyed(refs, parents, ["scope"], "at", "key", F.lit(2))
    hot = hot_keys(keys, ["scope"], "at", "key", bound=10)
    assert rows(hot) == [("a", 1, "gone")]
    found = join_hot(refs, orphan_keys(keys, ["scope"], "at", "key"), ["scope", "at", "key"], hot, "claim", salts=4)
    assert sorted(r.claim for r in found.collect()) == [*range(50), 51]
