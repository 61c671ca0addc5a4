from __future__ import annotations

from strataform.operators import architecture
from strataform.operators.edges import coupling, fan_in, merge_dependencies, merge_relationships
from tests.conftest import rows

EDGE = "p string, source string, target string, kind string, strength string, bidirectional boolean, confidence double, evidence array<string>"


def edge(source, kind, target, evidence=("x",), strength="strong", confidence=0.9):
    return ("p", source, target, kind, strength, False, confidence, list(evidence))


def scores(spark, relationships, deps=(), entrypoints=(), domains=()):
    r = spark.createDataFrame([*relationships], EDGE)
    d = spark.createDataFrame([("p", a, b, t, list(e)) for a, b, t, e in deps], "p string, source string, target string, type string, evidence array<string>")
    e = spark.createDataFrame([("p", f) for f in entrypoints], "p string, framework string")
    n = spark.createDataFrame([("p", x) for x in domains], "p string, name string")
    found = architecture.infer(architecture.signals(r, d, e, n, "p"), "p")
    return {x.pattern: (x.n_rules, x.support, x.conflict, x.confidence) for x in found.collect()}


def expected(n, support, conflict=0.0):
    raw = support / (support + conflict * 1.25 + 0.35) + min(n, 4) * 0.03
    return n, support, conflict, int(min(raw, 0.95) * 100 + 0.5) / 100


def test_layers(spark):
    rel = [edge("OrderController", "USES", "OrderService"), edge("OrderService", "USES", "OrderRepository"), edge("OrderRepository", "USES", "OrderEntity"), edge("Sql", "IMPLEMENTS", "Port")]
    assert scores(spark, rel) == {
        "MVC": expected(1, 1.4),
        "Clean Architecture": expected(2, 3.5),
        "Hexagonal": expected(1, 1.4),
        "Onion": expected(1, 1.0),
        "DDD": expected(1, 0.9),
        "Repository Pattern": expected(2, 2.6),
        "Service Layer": expected(1, 1.5),
    }


def test_conflicts_and_runtimes(spark):
    rel = [edge("A", "EXPOSES", "XController"), edge("HomeWidget", "USES", "HomeBloc"), edge("AppModule", "PROVIDES", "Y", ["domain"]), edge("Feature", "PROVIDES", "BillingFeature")]
    deps = [("a", "b", "package", ["declares dependency"]), ("a", "c", "package", []), ("a", "d", "dynamic-import", [])]
    got = scores(spark, rel, deps, ["NestJS", "Flutter"], ["Billing", "billing"])
    assert "MVC" not in got and expected(1, 1.2, 1.1)[3] < 0.55
    assert got["BLoC"] == expected(2, 2.3)
    assert got["Microservice"] == expected(2, 2.2)
    assert got["Modular Monolith"] == expected(3, 3.2)
    assert got["Plugin Architecture"] == expected(2, 2.4)
    assert got["Monorepo Workspace"] == expected(2, 1.9)
    assert got["Onion"] == expected(1, 1.2)
    assert got["DDD"] == expected(2, 1.8)


def test_no_edges_no_patterns(spark):
    assert scores(spark, []) == {}


def test_merges_and_counts(spark):
    df = spark.createDataFrame([edge("a", "USES", "b", ["y", "x"], "weak", 0.5), edge("a", "USES", "b", ["x", "z"], "strong", 0.4), edge("a", "USES", "a"), ("p", "a", "b", "USES", None, None, None, None)], EDGE)
    merged = merge_relationships(df, ["p"]).first()
    assert (merged.confidence, merged.strength, merged.bidirectional, merged.evidence) == (0.5, "strong", False, ["x", "y", "z"])
    d = spark.createDataFrame([("p", "a", "a", "import", 0.9, ["e"]), ("p", "a", "a", "module", 0.9, ["e"]), ("p", "a", "b", "import", 0.1, None)], "p string, source string, target string, type string, confidence double, evidence array<string>")
    assert rows(merge_dependencies(d, ["p"]).select("source", "target", "type")) == [("a", "a", "module"), ("a", "b", "import")]
    many = spark.createDataFrame([edge(f"s{i}", "USES", "hub") for i in range(6)] + [edge("s0", "USES", "t")], EDGE)
    assert rows(fan_in(many, ["p"])) == [("p", "hub", 6, "high", 0.92)]
    assert rows(coupling(many, ["p"])) == [("p", "hub", 6, "medium", 0.9)]
