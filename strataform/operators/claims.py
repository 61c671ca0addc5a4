"""Claims between snapshots: lifecycle, contradictions, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.functions import ids
from strataform.functions import numbers as N

#: Statuses from weakest to strongest.
STATUSES = ["INVALIDATED", "SUPERSEDED", "CONTRADICTED", "ACTIVE"]
FACT = ["subject", "predicate", "claim_object"]


def lifecycle(previous: DataFrame, following: DataFrame, scope: list[str]) -> DataFrame:
    """The claims after a step: scope, claim_id, status, superseded_by, confidence.

    ``previous`` (scope, claim_id, subject, predicate, claim_object, status, superseded_by, confidence) holds the claims before,
    ``following`` the live claims after. Facts that stay or come are ACTIVE; a fact that is gone is SUPERSEDED by the first rival (least
    claim_id) of its subject and predicate, INVALIDATED without one, and what was INVALIDATED before stays as it was. Of rows of one
    claim_id the strongest status counts, then the later source, then the greatest confidence.
    """
    null = lambda c: F.coalesce(F.col(c), F.lit(""))
    fact = F.struct(*[null(c).alias(c) for c in FACT])
    nxt, prev = following.withColumn("__fact", fact), previous.withColumn("__fact", fact)
    live = nxt.select(*scope, "claim_id", F.lit("ACTIVE").alias("status"), F.lit(None).cast("string").alias("superseded_by"), "confidence", F.lit(0).alias("__source"))
    gone = prev.join(nxt.select(*scope, "__fact").distinct(), [*scope, "__fact"], "left_anti")
    rivals = nxt.groupBy(*scope, F.col("__fact.subject").alias("__s"), F.col("__fact.predicate").alias("__p")).agg(F.min("claim_id").alias("__rival"))
    stepped = gone.withColumns({"__s": F.col("__fact.subject"), "__p": F.col("__fact.predicate")}).join(rivals, [*scope, "__s", "__p"], "left")
    stays = F.coalesce(F.col("status") == "INVALIDATED", F.lit(False))
    past = stepped.select(
        *scope,
        "claim_id",
        F.when(stays, F.col("status")).when(F.col("__rival").isNotNull(), "SUPERSEDED").otherwise("INVALIDATED").alias("status"),
        F.when(stays, F.col("superseded_by")).otherwise(F.col("__rival")).alias("superseded_by"),
        "confidence",
        F.lit(1).alias("__source"),
    )
    rank = N.rank_of(F.col("status"), STATUSES)
    best = F.max(F.struct(rank.alias("rank"), "__source", "confidence", "status", "superseded_by")).alias("__b")
    return live.unionByName(past).groupBy(*scope, "claim_id").agg(best).select(*scope, "claim_id", "__b.status", "__b.superseded_by", "__b.confidence")


def contradictions(claims: DataFrame, scope: list[str]) -> DataFrame:
    """Subjects with two or more live values of a predicate: id, values, claim ids, evidence ids (all in order, joined by |), least confidence."""
    live = claims.where(F.col("status").isin("ACTIVE", "CONTRADICTED") & F.col("claim_object").isNotNull())
    values = F.array_sort(F.collect_set("claim_object"))
    groups = live.groupBy(*scope, "subject", "predicate").agg(
        values.alias("vals"),
        F.array_sort(F.collect_set("claim_id")).alias("claims"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence_ids")))).alias("evidence"),
        F.min("confidence").alias("confidence"),
    )
    return groups.where(F.size("vals") >= 2).select(
        *scope,
        ids.contradiction_id(F.col("subject"), F.col("predicate"), F.col("vals")).alias("contradiction_id"),
        "subject",
        "predicate",
        F.array_join("vals", "|").alias("object_values"),
        F.array_join("claims", "|").alias("claim_ids"),
        F.array_join("evidence", "|").alias("evidence_ids"),
        "confidence",
    )


def explain(claims: DataFrame, evidence: DataFrame, scope: list[str]) -> DataFrame:
    """Per claim that names evidence: asked, found, distinct locators in order joined by |."""
    asked = claims.select(*scope, "claim_id", F.explode("evidence_ids").alias("evidence_id"))
    held = evidence.groupBy(*scope, "evidence_id").agg(F.min("locator").alias("locator"), F.lit(1).alias("held"))
    return (
        asked.join(held, [*scope, "evidence_id"], "left")
        .groupBy(*scope, "claim_id")
        .agg(F.count(F.lit(1)).alias("n_asked"), F.count("held").alias("n_found"), F.array_join(F.array_sort(F.collect_set("locator")), "|").alias("locators"))
    )


def links(claims: DataFrame, scope: list[str]) -> DataFrame:
    """The other way round: per evidence id the number of claims that name it and the least of them."""
    named = claims.select(*scope, "claim_id", F.explode("evidence_ids").alias("evidence_id"))
    return named.groupBy(*scope, "evidence_id").agg(F.count_distinct("claim_id").alias("n_claims"), F.min("claim_id").alias("first_claim"))
