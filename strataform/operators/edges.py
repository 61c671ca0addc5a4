"""Edges between components: merging, fan-in, coupling, reverse edges, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions import numbers as N


def _merged(edges: DataFrame, key: list[str], **greatest: Column) -> DataFrame:
    """One row per key with the greatest value of some columns and the distinct evidence strings in order.

    The strings are told apart in a first aggregation, by key and string, so nothing but distinct strings is gathered; one pass over the
    edges and no join.
    """
    rows = edges.select(*key, F.explode_outer("evidence").alias("e"), *[c.alias(n) for n, c in greatest.items()])
    once = rows.groupBy(*key, "e").agg(*[F.max(n).alias(n) for n in greatest])
    return once.groupBy(*key).agg(*[F.max(n).alias(n) for n in greatest], F.sort_array(F.collect_list("e")).alias("evidence"))


def merge_dependencies(edges: DataFrame, scope: list[str], keep_self: tuple[str, ...] = ("service", "repository", "module")) -> DataFrame:
    """One row per scope, source, target and type: greatest confidence, distinct evidence in order. Self edges stay for some types only."""
    kept = edges.where((F.col("source") != F.col("target")) | F.col("type").isin(*keep_self))
    return _merged(kept, [*scope, "source", "target", "type"], confidence=F.col("confidence"))


def merge_relationships(edges: DataFrame, scope: list[str]) -> DataFrame:
    """One row per scope, source, target and kind: greatest confidence and strength, bidirectional if any is, distinct evidence; no self edges."""
    kept = edges.where(F.col("source") != F.col("target"))
    # A strength that is none of the ordered ones ranks below them and is kept as null.
    rank = N.rank_of(F.col("strength"), N.STRENGTHS)
    merged = _merged(kept, [*scope, "source", "target", "kind"], confidence=F.col("confidence"), rank=rank, bidirectional=F.coalesce("bidirectional", F.lit(False)))
    strength = F.get(F.array(*[F.lit(x) for x in N.STRENGTHS]), F.col("rank") - 1)
    return merged.withColumn("strength", strength).drop("rank")


#: Kinds whose reverse edge may be of another of them.
CROSS_KINDS = ["USES", "CALLS", "DEPENDS_ON", "PROVIDES", "CONSUMES"]


def mark_bidirectional(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Sets ``bidirectional`` where the reverse edge exists with the same kind, or without it with any of CROSS_KINDS; both ends are marked.

    Pairs of names are reduced to their sets of kinds first (a bounded set), so a hub's edges meet only their own reverse.
    """
    kinds = edges.groupBy(*scope, "source", "target").agg(F.collect_set("kind").alias("__kinds"))
    back = kinds.select(*scope, F.col("source").alias("target"), F.col("target").alias("source"), F.col("__kinds").alias("__back"))
    pairs = kinds.join(back, [*scope, "source", "target"])
    one_way = lambda own, other: F.filter(
        own, lambda k: F.array_contains(other, k) | F.exists(other, lambda r: r.isin(CROSS_KINDS))
    )
    # An edge is marked by its own look at the reverse, or by the reverse edge's look at it.
    seen = one_way(F.col("__kinds"), F.col("__back"))
    theirs = F.filter(
        F.col("__kinds"),
        lambda k: F.exists(F.col("__back"), lambda r: (r == k) | (~F.array_contains(F.col("__kinds"), r) & k.isin(CROSS_KINDS))),
    )
    marked = pairs.select(*scope, "source", "target", F.array_union(seen, theirs).alias("__marked"))
    joined = edges.join(marked, [*scope, "source", "target"], "left")
    flag = F.coalesce(F.array_contains("__marked", F.col("kind")), F.lit(False)) | F.coalesce("bidirectional", F.lit(False))
    return joined.withColumn("bidirectional", flag).drop("__marked")


def fan_in(edges: DataFrame, scope: list[str], threshold: int = 3) -> DataFrame:
    """Targets with ``threshold`` or more inbound edges: n, severity, confidence."""
    counts = edges.groupBy(*scope, F.col("target")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)
    return _graded(counts, threshold, 0.5, 0.08, 0.92)


def coupling(edges: DataFrame, scope: list[str], threshold: int = 4) -> DataFrame:
    """Names at either end of ``threshold`` or more edges."""
    ends = edges.select(*scope, F.explode(F.array("source", "target")).alias("target"))
    counts = ends.groupBy(*scope, "target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)
    return _graded(counts, threshold, 0.48, 0.07, 0.9)


def _graded(counts: DataFrame, threshold: int, base: float, step: float, high: float) -> DataFrame:
    return counts.withColumns(
        {
            "severity": F.when(F.col("n") >= 2 * threshold, "high").otherwise("medium"),
            "confidence": N.confidence(F.least(F.lit(high), F.lit(base) + F.col("n") * step)),
        }
    )


def matching(kinds: list[str] | None = None, source: list[str] | None = None, target: list[str] | None = None, evidence: list[str] | None = None, kind: str = "kind") -> Column:
    """A predicate over edges: kind in a list and, case aside, some needle in the source, the target and the whole of names and evidence."""
    some = lambda c, needles: F.greatest(*[F.contains(F.lower(c), F.lit(n.lower())) for n in needles], F.lit(False))
    out = F.lit(True)
    if kinds:
        out &= F.col(kind).isin(*kinds)
    if source:
        out &= some(F.col("source"), source)
    if target:
        out &= some(F.col("target"), target)
    if evidence:
        out &= some(F.concat_ws(" ", "source", "target", F.array_join("evidence", " ")), evidence)
    return out
