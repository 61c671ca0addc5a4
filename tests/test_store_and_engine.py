from __future__ import annotations

from datetime import datetime

import pytest

from pyspark.sql import functions as F

from strataform.operators import claims, delta, edges, exclusions, findings, graph, matching
from strataform.plans.engine import QueryEngine, QueryError, QueryNotFound
from strataform.sources.snapshot_store import SnapshotConflict, SnapshotStore, annotations, stable_json
from tests.conftest import SMALL, rows


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, x string")
    assert rows(store.registry()) == []
    assert store.save("t", "s1", df, datetime(2025, 1, 1)) and not store.save("t", "s1", df.orderBy("i", ascending=False), datetime(2025, 1, 2))
    with pytest.raises(SnapshotConflict):
        store.save("t", "s1", df.limit(1), datetime(2025, 1, 3))
    store.save("t", "s2", df.limit(1), datetime(2025, 1, 3))
    assert rows(store.load("t", "s1")) == rows(df) and store.latest("t").count() == 1
    for bad in ("..", "a/b", ""):
        with pytest.raises(ValueError):
            store.load("t", bad)
    spark.createDataFrame([(9, "z")], "i int, x string").write.mode("append").parquet(str(tmp_path / "s/t/snapshot_id=s1"))
    with pytest.raises(ValueError):
        store.load("t", "s1")


def test_json_and_annotations(spark):
    df = spark.createDataFrame([("critical", "a,b.md", "r:1", "x%\ny"), ("info", "c", "r", None)], "severity string, path string, rule_id string, detail string")
    assert [r.value for r in annotations(df).collect()] == ["::error file=a%2Cb.md,title=r%3A1::x%25%0Ay", "::notice file=c,title=r::"]
    assert stable_json(df, ["path"]).first().value.startswith('{"detail":')


def test_engine(spark):
    e = QueryEngine(spark, SMALL)
    assert e.run("list domains").count > 0 and 0 < e.run("ListDependencies").confidence <= 1
    assert e.run("find_component", name="eventspine").count > 0
    with pytest.raises(QueryNotFound):
        e.run("FindDomain", name="no such domain")
    for bad in (dict(query="drop table"), dict(query="FindDomain"), dict(query="FindComponent", name="a\x00b"), dict(query="Trace", target="x", mode="odd")):
        with pytest.raises(QueryError):
            e.run(**bad)


@pytest.mark.parametrize(("counts", "score"), [((0, 0, 0), 100), ((1, 0, 0), 65), ((2, 0, 0), 41), ((0, 1, 0), 90), ((0, 2, 0), 83)])
def test_scores(spark, counts, score):
    df = spark.createDataFrame([(*counts, 0)], "n_critical int, n_warning int, n_info int, n_severe int")
    assert findings.scored(df).first().score == score


def test_lifecycle(spark):
    schema = "p string, claim_id string, subject string, predicate string, claim_object string, status string, superseded_by string, confidence double"
    before = [("p", "1", "s", "q", "a", "ACTIVE", None, 0.5), ("p", "2", "s", "q", "b", "ACTIVE", None, 0.5), ("p", "3", "t", "q", "c", "ACTIVE", None, 0.5), ("p", "4", "u", "q", "d", "INVALIDATED", "9", 0.5), ("p", "5", None, None, None, "ACTIVE", None, None)]
    after = [("p", "1", "s", "q", "a", "ACTIVE", None, 0.6), ("p", "6", "u", "q", "e", "ACTIVE", None, 0.6)]
    got = rows(claims.lifecycle(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), ["p"]).select("claim_id", "status", "superseded_by"))
    assert got == [("1", "ACTIVE", None), ("2", "SUPERSEDED", "1"), ("3", "INVALIDATED", None), ("4", "INVALIDATED", "9"), ("5", "INVALIDATED", None), ("6", "ACTIVE", None)]


def test_reach_with_cycles(spark):
    e = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "c", "d"), ("q", "a", "z"), ("p", None, "a")], "s string, source string, target string")
    roots = spark.createDataFrame([("p", "a"), ("p", "d")], "s string, node string")
    got = rows(graph.reach(e, roots, ["s"]).select("root", "node", "depth"))
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("d", "d", 0)]
    assert rows(graph.reach(e, roots, ["s"], "dependents").where("root = 'd'").select("node", "depth")) == [("a", 3), ("b", 2), ("c", 1), ("d", 0)]
    assert ("a", "c", 1) in rows(graph.reach(e, roots, ["s"], "blast-radius", 1).select("root", "node", "depth"))
    assert graph.reached_edges(e, graph.reach(e, roots, ["s"]), ["s"]).where("root = 'a'").count() == 4


def test_deltas(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "k int, v string")
    assert rows(delta.keyed_delta(a, b, ["k"], ["v"])) == [(1, "unchanged"), (2, "changed"), (3, "removed"), (4, "added")]
    assert rows(delta.row_delta(a, b)) == sorted([(2, "y", "+"), (4, None, "+"), (2, None, "-"), (3, "z", "-")], key=repr)


def test_reverse_edges(spark):
    df = spark.createDataFrame([("p", "a", "b", "USES", False), ("p", "b", "a", "CALLS", False), ("p", "a", "c", "OWNS", False), ("p", "c", "a", "USES", False), ("p", "d", "e", "OWNS", False), ("p", "e", "d", "OWNS", None)], "s string, source string, target string, kind string, bidirectional boolean")
    got = {(r.source, r.target): r.bidirectional for r in edges.mark_bidirectional(df, ["s"]).collect()}
    assert got == {("a", "b"): True, ("b", "a"): True, ("a", "c"): True, ("c", "a"): True, ("d", "e"): True, ("e", "d"): True}


def test_owners_and_ignores(spark):
    given = [("r", "*.md", "docs", "codeowners"), ("r", "/a/", "team", "codeowners"), ("r", "/a/b/", "deep", "package"), ("r", "/a/", "wide", "package"), ("r", "*", "all", "maintainers")]
    frame = lambda r: spark.createDataFrame(r, "s string, pattern string, owner string, source string")
    df = spark.createDataFrame([("r", "a/x.md"), ("r", "a/b/c"), ("r", "z.md"), ("r", "q"), ("t", "q"), ("r", None)], "s string, path string")
    owner = lambda r: rows(matching.resolve_owners(df, frame(r), ["s"]).where("s = 'r'").select("path", "owner"))
    assert owner(given) == [("a/b/c", "team"), ("a/x.md", "team"), ("q", "all"), ("z.md", "docs")]
    assert owner(given[2:])[0] == ("a/b/c", "deep")
    assert rows(matching.resolve_owners(df, frame(given), ["s"]).where("owner is null").select("s", "path")) == [("t", "q")]
    # More rules than anyone writes are rows as well.
    many = [*given, *[("r", f"/x{i}/", f"o{i}", "codeowners") for i in range(12_000)]]
    assert owner(many) == owner(given)
    ignore = spark.createDataFrame([("r", 1, "*.md", False), ("r", 2, "z.md", True)], "s string, ord int, pattern string, keep boolean")
    assert rows(exclusions.ignored(df, ignore, ["s"]).select("path")) == [("a/x.md",)]
    assert rows(exclusions.ignored(df, ignore.limit(0), ["s"])) == []


PATTERNS = ["*.md", "a/", "a/b/", "/a/x.md", "a/b", "x.md", "b/*.md", "**/x.md", "a/**/c", "/*", "?.md", "*.t?", "a**", ".env", ".env.*", "[x].md", "a/b/**", "build/", "*"]


def test_pattern_columns_mean_what_the_patterns_mean(spark):
    import re

    from strataform.functions import paths as P

    tried = ["a/x.md", "a", "a/b", "a/b/c", "a/b/d/c", "x.md", "b/x.md", "q/b/x.md", ".env", "k/.env.local", "z.ts", "w/build/o.js", "[x].md", "ab", "q/a/b", "q/a/b/c", "*.md", "d/*.t?/e"]
    df = spark.createDataFrame([("s", p) for p in tried], "s string, path string")
    for kind, python, column in (("ignore", P.ignore_regex, P.ignore_regex_of), ("owners", lambda p: ".*" if p == "*" else P.owners_regex(p), P.owners_regex_of)):
        # Every pattern is the only one of its own scope.
        rules = spark.createDataFrame([(p, 0, p) for p in PATTERNS], "s string, ord int, pattern string")
        each = df.drop("s").crossJoin(rules.select("s"))
        ready = matching.anchored(rules, F.col("pattern")).withColumn("regex", column(F.col("pattern")))
        got = {(r.s, r.path) for r in matching.last_rule(each, ready, ["s"], "pattern").collect()}
        assert got == {(p, t) for p in PATTERNS for t in tried if re.search(python(p), t)}, kind


def test_reach_goes_to_the_end_and_tells_where_it_stops(spark):
    chain = spark.createDataFrame([("s", f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("s", "n30", "n00")], "s string, source string, target string")
    roots = spark.createDataFrame([("s", "n00")], "s string, node string")
    assert graph.reach(chain, roots, ["s"]).agg(F.max("depth")).first()[0] == 30
    cut = graph.reach(chain, roots, ["s"], max_depth=5)
    assert cut.count() == 6 and {r.truncated for r in cut.collect()} == {True}
    short = chain.where("source < 'n04'")
    assert {r.truncated for r in graph.reach(short, roots, ["s"], max_depth=9).collect()} == {False}


def test_duplicates_and_metrics(spark):
    body = "word " * 30
    df = spark.createDataFrame([(3, body), (1, body.upper() + "\r\n"), (2, None), (4, "short"), (5, ""), (1, body.upper() + "\r\n")], "doc_id bigint, text string")
    assert rows(matching.duplicate_classes(df, [], "doc_id", "text")) == [(1, 1, 2), (3, 1, 2)]
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "s string, i int")
    a = spark.createDataFrame([("a", 2), ("a", 3), ("c", 1)], "s string, i int")
    assert rows(matching.set_metrics(t, a, ["s"], "i")) == [("a", 1, 1, 1, 0.5, 0.5, 0.5), ("b", 0, 0, 1, 1.0, 0.0, 0.0), ("c", 0, 1, 0, 0.0, 1.0, 0.0)]
