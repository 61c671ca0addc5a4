"""Findings: summaries, removal of repeats, decaying scores, gates and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions import numbers as N


def summarize(findings: DataFrame, scope: list[str]) -> DataFrame:
    """Counts by severity and in all."""
    return findings.groupBy(*scope).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in reversed(N.SEVERITIES)], F.count(F.lit(1)).alias("n_total"))


def dedupe(findings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: agents united in order, severity and id of the severest finding, the first by ``order`` among equals."""
    agents = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("agents", F.array().cast("array<string>"))))))
    rank = N.rank_of(F.col("severity"), N.SEVERITIES)
    best = F.min(F.struct((-rank).alias("r"), F.col(order).alias("o"), F.col("severity").alias("severity"))).alias("__b")
    return findings.groupBy(*keys).agg(best, agents.alias("agents"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("__b.o").alias(order), "__b.severity", "agents", "n")


def decayed(n: Column) -> Column:
    """Sum of the weights 1, .7, .5, .35, .35 ... of n findings of one severity, in hundredths."""
    return F.when(n <= 0, 0).when(n == 1, 100).when(n == 2, 170).otherwise(F.lit(220) + F.greatest(n - 3, F.lit(0)) * 35)


#: What a severity takes from a score of 100, before decay.
PENALTY = {"critical": 35, "warning": 10, "info": 2}


def scores(findings: DataFrame, scope: list[str], security: str = "security") -> DataFrame:
    """Score 0 to 100 per scope, the n-th finding of a severity weighing less; one critical security finding caps it at 69, more at 49.

    Counts are all that matters, so one combined aggregation gives it; the arithmetic is in hundredths of integers.
    """
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in PENALTY]
    capped = F.count_if((F.col("severity") == "critical") & (F.col("category") == security)).alias("n_severe")
    return scored(findings.groupBy(*scope).agg(*counts, capped)).select(*scope, "score")


def scored(counts: DataFrame) -> DataFrame:
    loss = sum((decayed(F.col(f"n_{s}")) * p for s, p in PENALTY.items()), F.lit(0))
    raw = F.floor((F.lit(10000) - loss + 50) / 100)
    cap = F.when(F.col("n_severe") >= 2, 49).when(F.col("n_severe") == 1, 69).otherwise(100)
    return counts.withColumn("score", F.greatest(F.least(raw, cap), F.lit(0)).cast("int"))


def scopes(findings: DataFrame, repo: str) -> DataFrame:
    """Scores over all, by category and by agent: three grouping sets in one pass; the cap holds for the whole only."""
    by_agent = findings.select(repo, "severity", "category", F.explode(F.array_union(F.array(F.lit("")), F.coalesce("agents", F.array().cast("array<string>")))).alias("agent"))
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in PENALTY]
    severe = F.count_if((F.col("severity") == "critical") & (F.col("category") == "security")).alias("n_severe")
    whole = by_agent.where("agent = ''").groupBy(repo).agg(*counts, severe).select(repo, F.lit("overall").alias("scope"), F.lit("").alias("name"), "*")
    category = by_agent.where("agent = ''").groupBy(repo, "category").agg(*counts).select(repo, F.lit("category").alias("scope"), F.col("category").alias("name"), "*")
    agent = by_agent.where("agent <> ''").groupBy(repo, "agent").agg(*counts).select(repo, F.lit("agent").alias("scope"), F.col("agent").alias("name"), "*")
    columns = ["scope", "name", *[f"n_{s}" for s in PENALTY]]
    parts = [d.select(F.col(repo).alias("__repo"), *columns, s.alias("n_severe")) for d, s in ((_once(whole, repo), F.col("n_severe")), (_once(category, repo), F.lit(0)), (_once(agent, repo), F.lit(0)))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return scored(out).select(F.col("__repo").alias(repo), "scope", "name", "score")


def _once(df: DataFrame, repo: str) -> DataFrame:
    """The frame without the second copy of the scope column that ``*`` brings."""
    names = list(dict.fromkeys(df.columns))
    return df.toDF(*[c if df.columns.index(c) == i else f"__{i}" for i, c in enumerate(df.columns)]).select(*names)


def gates(summary: DataFrame, repo: str, min_score: int | None = None, fail_on: str | None = None, fail_on_new: bool = False) -> DataFrame:
    """Violations: repo, gate, value. ``summary``: repo, score, n_critical, n_warning, n_info, and as far as the gates need them ``limited``
    (no agent is set up, so a least score can't be enforced), ``n_ruled`` (findings of the rules that fail) and ``n_new``.

    minimum-score: the score below a minimum, unknown, or not to be enforced (the value is the score). fail-on-severity: findings at a
    severity or above. fail-on-rule: findings of named rules. fail-on-new: findings that the baseline lacks. Nulls count as none.
    """
    some = lambda c: F.coalesce(F.col(c) if c in summary.columns else F.lit(0), F.lit(0)).cast("long")
    found = []
    gate = lambda name, fails, value: F.struct(F.lit(name).alias("gate"), fails.alias("fails"), value.cast("long").alias("value"))
    if min_score is not None:
        limited = F.coalesce(F.col("limited"), F.lit(False)) if "limited" in summary.columns else F.lit(False)
        found.append(gate("minimum-score", limited | F.col("score").isNull() | (F.col("score") < min_score), F.col("score")))
    if fail_on is not None:
        n = sum((some(f"n_{s}") for s in N.SEVERITIES[N.SEVERITIES.index(fail_on) :]), F.lit(0))
        found.append(gate("fail-on-severity", n > 0, n))
    found.append(gate("fail-on-rule", some("n_ruled") > 0, some("n_ruled")))
    if fail_on_new:
        found.append(gate("fail-on-new", some("n_new") > 0, some("n_new")))
    return summary.select(repo, F.explode(F.array(*found)).alias("x")).where("x.fails").select(repo, "x.gate", "x.value")


def compare(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, status: new, resolved or remaining; repeated keys count once."""
    b = before.select(key).dropna().distinct().withColumn("__b", F.lit(1))
    a = after.select(key).dropna().distinct().withColumn("__a", F.lit(1))
    status = F.when(F.col("__b").isNull(), "new").when(F.col("__a").isNull(), "resolved").otherwise("remaining")
    return b.join(a, key, "full").select(key, status.alias("status"))
