from __future__ import annotations

import random
from datetime import datetime, timedelta

from strataform.operators.history import attribute_intervals, attribute_log, effective_events, split_hot, versions
from strataform.streaming.history import HistoryStream
from tests.conftest import rows

START = datetime(2025, 1, 1)
SCHEMA = "k string, eff timestamp, purge boolean, status string, sup string, loaded bigint"
ATTRS = ["status", "sup"]


def brute(data):
    out = []
    for k in sorted({d[0] for d in data if d[0] is not None}):
        last = {}
        for d in data:
            if d[0] == k and d[1] is not None and (d[1] not in last or (d[5], d[2] or False, d[3] or "", d[4] or "") > (last[d[1]][5], last[d[1]][2] or False, last[d[1]][3] or "", last[d[1]][4] or "")):
                last[d[1]] = d
        now, since = None, None
        for t in [*sorted(last), None]:
            state = None if t is None or last[t][2] else (last[t][3], last[t][4])
            if t is not None and state == now:
                continue
            if now is not None:
                out.append((k, *now, since, t))
            now, since = state, t
    return sorted(out, key=repr)


def made(rnd, n):
    return [
        (rnd.choice(["hot"] * 5 + ["a", "b"]), START + timedelta(hours=rnd.randint(0, 400)), rnd.random() < 0.15, rnd.choice(["A", "I", None]), rnd.choice(["x", None]), i)
        for i in range(n)
    ]


def run(spark, data, chunked=False):
    df = spark.createDataFrame(data, SCHEMA)
    log = attribute_log(effective_events(df, ["k"], "eff", "purge", ATTRS, ["loaded"], chunked), ["k"], ATTRS, chunked)
    return log, rows(versions(log, ["k"], ATTRS, chunked))


def test_versions_equal_a_replay(spark):
    rnd = random.Random(11)
    data = made(rnd, 300)
    assert run(spark, data)[1] == brute(data)
    assert run(spark, data, chunked=True)[1] == brute(data)


def test_neighbouring_versions_differ(spark):
    for chunked in (False, True):
        found = run(spark, made(random.Random(3), 400), chunked)[1]
        for a, b in zip(found, found[1:], strict=False):
            assert a[0] != b[0] or a[4] != b[3] or a[1:3] != b[1:3]


def test_large_entities_are_told_apart(spark):
    df = spark.createDataFrame([("hot", i) for i in range(9)] + [("a", 1), (None, 2)], "k string, v int")
    cold, hot = split_hot(df, ["k"], 5)
    assert {r.k for r in hot.collect()} == {"hot"} and {r.k for r in cold.collect()} == {"a", None}
    assert split_hot(df, ["k"], 9)[1] is None


def test_nulls_repeats_and_empty(spark):
    t = START
    data = [("a", t, None, "A", None, 1), ("a", t, None, "A", None, 1), ("a", None, False, "I", None, 2), (None, t, False, "A", None, 3), ("b", t, True, None, None, 4)]
    assert run(spark, data)[1] == [("a", "A", None, t, None)]
    assert run(spark, [])[1] == []


def test_intervals_of_each_attribute(spark):
    h = lambda n: START + timedelta(hours=n)
    log, _ = run(spark, [("a", h(0), False, "A", "x", 1), ("a", h(1), False, "I", "x", 2), ("a", h(30), True, None, None, 3)])
    assert rows(attribute_intervals(log, ["k"])) == [("a", "status", "A", h(0), h(1)), ("a", "status", "I", h(1), h(30)), ("a", "sup", "x", h(0), h(30))]


def test_stream_of_batches_gives_the_same_versions(spark, tmp_path):
    data = made(random.Random(2), 120)
    stream = HistoryStream(str(tmp_path / "h"), ["k"], ATTRS, ["loaded"])
    for i in range(3):
        src = spark.createDataFrame(data[i * 40 : i * 40 + 40], SCHEMA)
        src.write.mode("append").parquet(str(tmp_path / "in"))
        updates = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream.start(updates, str(tmp_path / "ckpt")).awaitTermination()
    assert rows(stream.versions(spark).select("k", *ATTRS, "since", "until")) == brute(data)
