"""Architecture scores: one aggregation of signal counts per scope, then a table of weighted rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions import numbers as N
from strataform.operators.edges import matching

#: Signals over relationships: name -> predicate.
RELATIONSHIP_SIGNALS = {
    "route_controller": dict(kinds=["EXPOSES"], target=["Controller"]),
    "controller_service": dict(kinds=["USES", "CALLS"], source=["Controller"], target=["Service"]),
    "controller_uses_service": dict(kinds=["USES"], source=["Controller"], target=["Service"]),
    "app_service": dict(kinds=["USES", "CALLS"], source=["Controller", "API", "Route"], target=["Service"]),
    "api_service": dict(kinds=["CALLS"], source=["API"], target=["Service"]),
    "widget_bloc": dict(kinds=["USES"], source=["Widget"], target=["Bloc"]),
    "bloc_repository": dict(kinds=["USES"], source=["Bloc"], target=["Repository"]),
    "viewmodel": dict(evidence=["viewmodel", "view-model"]),
    "view_model_edge": dict(kinds=["USES"], source=["Widget", "View"], target=["Service", "ViewModel", "Model"]),
    "service_repository": dict(kinds=["USES"], source=["Service"], target=["Repository"]),
    "repository_database": dict(kinds=["USES"], source=["Repository"], target=["Database", "Entity"]),
    "implements": dict(kinds=["IMPLEMENTS"]),
    "controller_repository": dict(kinds=["USES"], source=["Controller"], target=["Repository", "Database", "Entity"]),
    "controller_database": dict(kinds=["USES"], source=["Controller"], target=["Database", "Entity"]),
    "layer_1": dict(kinds=["USES", "CALLS", "EXPOSES"], evidence=["Controller → Service"]),
    "layer_2": dict(kinds=["USES"], evidence=["Service → Repository"]),
    "layer_3": dict(kinds=["USES"], evidence=["Repository → Database"]),
    "module_provides": dict(kinds=["PROVIDES"], source=["Module"]),
    "module_wires": dict(kinds=["PROVIDES", "CONFIGURES"], source=["Module"]),
    "configures": dict(kinds=["CONFIGURES"]),
    "contains": dict(kinds=["CONTAINS"]),
    "consumes": dict(kinds=["CONSUMES"]),
    "owns": dict(kinds=["OWNS"]),
    "provides_domain": dict(kinds=["PROVIDES"], evidence=["domain"]),
    "riverpod": dict(evidence=["riverpod", "provider"]),
    "redux": dict(evidence=["redux", "reducer", "store"]),
}

#: Signals over dependencies.
DEPENDENCY_SIGNALS = {
    "package": dict(kinds=["package"]),
    "declared": dict(kinds=["package"], evidence=["declares dependency", "package"]),
    "dynamic": dict(kinds=["dynamic-import"]),
}



def _has(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n) > 0 for n in names])


def _none(name: str) -> Column:
    return F.col(name) == 0


def _up_to(name: str, most: int) -> Column:
    return F.least(F.col(name), F.lit(most)).cast("double")


#: Fixed values inside: the weights of the rules.
def rules() -> dict[str, tuple[list, list]]:
    """Pattern -> (rules that support it, rules that speak against it): each (condition, weight). A weight may count; a weight of 0 is a rule still."""
    one = F.lit(1.0)
    depth = reduce(lambda a, b: a + b, [_has(f"layer_{i}").cast("int") for i in (1, 2, 3)])
    chain = _has("controller_service", "service_repository", "repository_database")
    return {
        "MVC": ([(_has("route_controller"), one * 1.2), (_has("controller_service"), one * 1.4)], [(_has("widget_bloc"), one * 1.1)]),
        "MVVM": (
            [(_has("viewmodel"), one * 1.5), (_has("view_model_edge", "viewmodel"), one)],
            [(_has("controller_uses_service") & _none("viewmodel"), one * 0.8)],
        ),
        "Clean Architecture": (
            [
                (chain, one * 2.2),
                (~chain & _has("controller_service"), one * 0.7),
                (~chain & _has("service_repository"), one * 0.8),
                (~chain & _has("repository_database"), one * 0.8),
                (_has("implements"), one * 1.3),
            ],
            [(_has("controller_repository"), _up_to("controller_repository", 3) * 1.2)],
        ),
        "Layered Architecture": ([(_has(f"layer_{i}"), F.when(depth >= 2, 0.9).otherwise(0.0)) for i in (1, 2, 3)], []),
        "Hexagonal": ([(_has("implements"), one * 1.4), (_has("module_provides"), one), (_has("configures"), one * 0.8)], [(_has("controller_database"), one)]),
        "Onion": ([(_has("n_domains") & (_has("provides_named_domain") | _has("contains")), one * 1.2), (_has("service_repository"), one)], []),
        "DDD": ([(_has("n_domains"), _up_to("n_domains", 3) * 0.7), (_has("provides_domain"), one * 1.1), (_has("repository_database"), one * 0.9)], []),
        "Repository Pattern": ([(_has("service_repository"), one * 1.4), (_has("repository_database"), one * 1.2)], [(_has("controller_database"), one)]),
        "Service Layer": ([(_has("app_service"), one * 1.5), (_has("api_service"), one * 1.1)], []),
        "Feature-first": ([(F.col("contains") >= 2, one * 1.3), (_has("consumes"), one * 1.2), (_has("owns"), one * 0.8)], []),
        "BLoC": (
            [(_has("widget_bloc"), one * 1.6), (_has("bloc_repository"), one * 1.3), (_has("n_flutter"), one * 0.7)],
            [(_has("controller_service"), one * 0.4)],
        ),
        "Riverpod": ([(_has("riverpod"), one * 1.5)], [(_has("riverpod") & _none("n_flutter"), one * 0.6)]),
        "Redux": ([(_has("redux"), one * 1.5)], []),
        "Microservice": (
            [(F.col("n_frameworks") >= 2, F.col("n_frameworks") * 0.7), (F.col("package") >= 2, one * 0.8)],
            [((F.col("n_frameworks") >= 2) & _has("configures") & (F.col("package") <= 1), one * 0.7)],
        ),
        "Modular Monolith": (
            [
                (_has("module_wires"), one * 1.4),
                (_has("n_nest") | ((F.col("n_frameworks") == 1) & _has("module_wires")), one),
                (_has("package", "module_wires"), one * 0.8),
            ],
            [(F.col("n_frameworks") >= 3, one * 0.9)],
        ),
        "Plugin Architecture": ([(_has("dynamic"), one * 1.5), (_has("dynamic", "module_provides"), one * 0.9)], []),
        "Monorepo Workspace": ([(_has("package"), _up_to("package", 4) * 0.55), (_has("declared"), one * 0.8), (_has("owns"), one * 0.7)], []),
    }


def signals(relationships: DataFrame, dependencies: DataFrame, entrypoints: DataFrame, domains: DataFrame, scope: str) -> DataFrame:
    """One row per scope with the count of every signal; inputs without rows of a scope count 0."""
    count = lambda preds, kind: [F.count_if(matching(**p, kind=kind)).alias(n) for n, p in preds.items()]
    # The target in its own case, where the edges bring it beside the key.
    own = "target_name" if "target_name" in relationships.columns else "target"
    names = domains.select(scope, F.lower("name").alias("name")).dropna().distinct()
    # PROVIDES edges whose target names a domain of the scope: words of the target meet the names by equality.
    words = relationships.where("kind = 'PROVIDES'").select(scope, "source", "target", F.explode(F.split(F.lower(F.regexp_replace(own, "([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+")).alias("name"))
    named = words.join(names, [scope, "name"], "left_semi").select(scope, "source", "target").distinct().groupBy(scope).agg(F.count(F.lit(1)).alias("provides_named_domain"))
    parts = [
        relationships.groupBy(scope).agg(*count(RELATIONSHIP_SIGNALS, "kind"), F.count_if(matching(**RELATIONSHIP_SIGNALS["widget_bloc"]) & (F.size("evidence") > 0)).alias("widget_bloc_told")),
        dependencies.groupBy(scope).agg(*count(DEPENDENCY_SIGNALS, "type")),
        entrypoints.groupBy(scope).agg(
            F.countDistinct("framework").alias("n_frameworks"),
            F.count_if(F.col("framework") == "NestJS").alias("n_nest"),
            F.count_if(F.col("framework") == "Flutter").alias("n_flutter"),
        ),
        names.groupBy(scope).agg(F.count(F.lit(1)).alias("n_domains")),
        named,
    ]
    return reduce(lambda a, b: a.join(b, scope, "full"), parts).na.fill(0)


def conflicts(signal_counts: DataFrame, scope: str, minimum: float = 0.55) -> DataFrame:
    """scope, pattern, n of the inferred patterns that something speaks against: n pieces of conflicting evidence.

    Every rule against a pattern tells one piece, but MVC's one for each of up to three edges with evidence.
    """
    cells = []
    for pattern, (_, against) in rules().items():
        told = [F.least(F.col("widget_bloc_told"), F.lit(3)) if pattern == "MVC" else r[0].cast("long") for r in against]
        cells.append(F.struct(F.lit(pattern).alias("pattern"), reduce(lambda a, b: a + b, told, F.lit(0).cast("long")).alias("n")))
    counts = signal_counts.select(scope, F.explode(F.array(*cells)).alias("x")).select(scope, "x.*").where("n > 0")
    return counts.join(infer(signal_counts, scope, minimum).select(scope, "pattern"), [scope, "pattern"], "left_semi")


def infer(signal_counts: DataFrame, scope: str, minimum: float = 0.55) -> DataFrame:
    """scope, pattern, n_rules, support, conflict, confidence of every pattern with support and at least ``minimum``."""
    zero = F.lit(0.0)
    cells = []
    for pattern, (support, conflict) in rules().items():
        total = lambda rs: reduce(lambda a, r: a + F.when(r[0], r[1]).otherwise(zero), rs, zero)
        n = reduce(lambda a, r: a + r[0].cast("int"), support, F.lit(0))
        cells.append(
            F.struct(F.lit(pattern).alias("pattern"), n.cast("long").alias("n_rules"), N.js_round(total(support)).alias("support"), N.js_round(total(conflict)).alias("conflict"))
        )
    rows = signal_counts.select(scope, F.explode(F.array(*cells)).alias("x")).select(scope, "x.*")
    scored = rows.withColumn("confidence", N.pattern_confidence(F.col("support"), F.col("conflict"), F.col("n_rules")))
    return scored.where((F.col("confidence") > 0) & (F.col("confidence") >= minimum))
