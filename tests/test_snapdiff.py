from __future__ import annotations

import random

from pyspark.sql import functions as F

from strataform.operators.snapdiff import extended, ordinals, snapshot_changes
from tests.conftest import rows


def chain(spark, pairs, buckets):
    out = []
    for p in sorted({p for p, _ in pairs}):
        own = sorted(s for q, s in pairs if q == p)
        out += [(p, s, i + 1, own[i + 1] if i + 1 < len(own) else None, buckets) for i, s in enumerate(own)]
    return spark.createDataFrame(out, "p string, s string, seq int, next_snapshot string, n_buckets int")


def brute(data):
    out = []
    for p in {d[0] for d in data}:
        own = sorted({d[1] for d in data if d[0] == p})
        at = {s: {k: v for q, t, k, v in data if q == p and t == s} for s in own}
        for a, b in zip(own, own[1:], strict=False):
            out += [(p, b, k, "added") for k in at[b].keys() - at[a].keys()] + [(p, b, k, "removed") for k in at[a].keys() - at[b].keys()]
            out += [(p, b, k, "changed") for k in at[a].keys() & at[b].keys() if at[a][k] != at[b][k]]
    return sorted(out, key=repr)


def test_bitmaps_equal_brute_force(spark):
    rnd = random.Random(5)
    seen = {}
    for _ in range(3000):
        seen[rnd.choice("pq"), f"s{rnd.randint(1, 5)}", f"k{rnd.randint(0, 400):03d}"] = rnd.choice(["A", "B", None])
    data = [(*k, v) for k, v in seen.items()]
    df = spark.createDataFrame(data, "p string, s string, k string, v string").select("p", "s", "k", F.struct("v").alias("value"))
    for buckets in (1, 3):
        snaps = chain(spark, {(d[0], d[1]) for d in data}, buckets)
        assert rows(snapshot_changes(df, snaps, "p", "s", "k", "value")) == brute(data)


def test_all_64_bits_of_a_word_come_and_go(spark):
    data = [("p", "s1", f"k{i:03d}", "A") for i in range(130)] + [("p", "s2", "k063", "A"), ("p", "s3", "k127", "B")]
    df = spark.createDataFrame(data, "p string, s string, k string, v string").select("p", "s", "k", F.struct("v").alias("value"))
    assert rows(snapshot_changes(df, chain(spark, {(d[0], d[1]) for d in data}, 1), "p", "s", "k", "value")) == brute(data)


def test_empty(spark):
    df = spark.createDataFrame([], "p string, s string, k string, value struct<v: string>")
    snaps = spark.createDataFrame([], "p string, s string, seq int, next_snapshot string, n_buckets int")
    assert rows(snapshot_changes(df, snaps, "p", "s", "k", "value")) == []


def test_a_later_snapshot_leaves_the_ordinals_before_it(spark):
    data = [("p", 1, "m"), ("p", 1, "z"), ("p", 2, "a"), ("p", 2, "z"), ("q", 1, "a")]
    of = lambda d: {(r.p, r.k): r["__ord"] for r in ordinals(spark.createDataFrame(d, "p string, seq int, k string"), ["p"], "k", "seq").collect()}
    before, after = of(data), of([*data, ("p", 3, "b"), ("p", 3, "0")])
    assert before == {("p", "m"): 0, ("p", "z"): 1, ("p", "a"): 2, ("q", "a"): 0}
    assert after == before | {("p", "0"): 3, ("p", "b"): 4}
    stored = spark.createDataFrame([(p, k, o) for (p, k), o in before.items()], "p string, k string, __ord int")
    more = spark.createDataFrame([("p", "b"), ("p", "0"), ("p", "m"), ("r", "a"), ("p", None)], "p string, k string")
    assert {(r.p, r.k): r["__ord"] for r in extended(stored, more, ["p"], "k").collect()} == after | {("r", "a"): 0}


def test_a_dimension_beyond_the_bound_meets_its_rows_over_salts(spark):
    from strataform.operators.skew import join_dimension

    left = spark.createDataFrame([("p", f"k{i}") for i in range(40)] + [("q", "k1"), (None, "x")], "p string, k string")
    dim = spark.createDataFrame([("p", 7), ("r", 8)], "p string, n int")
    assert rows(join_dimension(left, dim, ["p"], "k", limit=1, salts=4)) == rows(join_dimension(left, dim, ["p"], "k")) == sorted(("p", f"k{i}", 7) for i in range(40))
