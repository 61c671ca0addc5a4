"""Queries of the general problems 1 to 5 over the claim-store tables, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.clean import hundredths, norm_key, norm_keys, norm_upper
from strataform.operators import eager, history, nested, snapdiff
from strataform.operators.orphans import hot_keys, keyed, orphan_keys
from strataform.operators.skew import join_dimension, join_hot
from strataform.sources.shared import written
from strataform.sources.tables import table

#: Rows of a project that share one bucket of the windows; a larger project is cut by key hash.
ROWS_PER_BUCKET = 250_000

IDS = ["project_id", "snapshot_id"]


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered snapshots, one row each: project_id, snapshot_id, created_at."""
    meta = table(spark, sf_dir, "snapshot_meta").select(*[norm_key(c).alias(c) for c in IDS], "created_at")
    return meta.dropna().groupBy(*IDS).agg(F.min("created_at").alias("created_at"))


def latest_claims(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    """One row per project, snapshot and claim: the one with the greatest loaded_at (null is least, then the greatest values)."""
    keys = [*IDS, "claim_id"]
    claims = table(spark, sf_dir, "brain_claims").select(
        *[norm_key(c).alias(c) for c in keys], F.struct("loaded_at", *[v.alias(c) for c, v in columns.items()]).alias("r")
    )
    claims = claims.dropna(subset=keys).groupBy(*keys).agg(F.max("r").alias("r"))
    return claims.select(*keys, *[f"r.{c}" for c in columns])


# Problem 1

PARENTS = (("evidence_ids", "brain_evidence", "evidence_id"), ("superseded_by", "brain_claims", "claim_id"), ("contradiction_ids", "brain_contradictions", "contradiction_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = latest_claims(
        spark, sf_dir, evidence_ids=norm_keys("evidence_ids"), superseded_by=F.array(norm_key("superseded_by")), contradiction_ids=norm_keys("contradiction_ids")
    )
    # Buckets by all keys a project brings, the elements of its arrays and not only its rows.
    raw = table(spark, sf_dir, "brain_claims")
    brought = F.greatest(F.size("evidence_ids"), F.lit(0)) + F.greatest(F.size("contradiction_ids"), F.lit(0)) + 2
    sizes = raw.select(norm_key("project_id").alias("project_id"), brought.alias("n"))
    for _, t, _ in PARENTS[::2]:
        sizes = sizes.unionByName(table(spark, sf_dir, t).select(norm_key("project_id").alias("project_id"), F.lit(1).alias("n")))
    counts = sizes.groupBy("project_id").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(ROWS_PER_BUCKET))).cast("int").alias("n_buckets"))
    dim = written(snapshots(spark, sf_dir).join(counts, "project_id"))
    fields = F.array(*[F.struct(F.lit(i).cast("byte").alias("field"), F.col(f).alias("ids")) for i, (f, _, _) in enumerate(PARENTS)])
    refs = (
        join_dimension(claims, dim, IDS, "claim_id")
        .select(*IDS, "created_at", "n_buckets", "claim_id", F.inline(fields))
        .select(*IDS, "created_at", "n_buckets", "claim_id", "field", F.explode("ids").alias("ref_id"))
        .where("ref_id is not null")
    )
    parents = None
    for i, (_, t, c) in enumerate(PARENTS):
        one = table(spark, sf_dir, t).select(*[norm_key(x).alias(x) for x in IDS], norm_key(c).alias("ref_id"))
        one = join_dimension(one, dim, IDS, "ref_id").select("project_id", F.lit(i).cast("byte").alias("field"), "created_at", "n_buckets", "ref_id")
        parents = one if parents is None else parents.unionByName(one)
    scope, at, key = ["project_id", "field"], "created_at", "ref_id"
    keys = written(keyed(refs, parents, scope, at, key, F.col("n_buckets")))
    orphans = orphan_keys(keys, scope, at, key)
    reason = F.when(F.col("first_at") < F.col("created_at"), "deleted").when(F.col("last_at") > F.col("created_at"), "late").otherwise("missing")
    name = F.element_at(F.array(*[F.lit(f) for f, _, _ in PARENTS]), F.col("field") + 1)
    return join_hot(refs, orphans, [*scope, at, key], hot_keys(keys, scope, at, key), "claim_id").select(
        name.alias("ref_field"), "snapshot_id", "claim_id", "ref_id", reason.alias("reason"), F.date_format("created_at", "yyyy-MM").alias("period")
    )


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted per reference field, reason and month."""
    return p1_found(spark, sf_dir).groupBy("ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_id").alias("n_keys"))


# Problem 2

EDGES = (("dependency_matches", "dep_to"), ("relationship_matches", "rel_target"))


def _edges(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [
        table(spark, sf_dir, t).select(norm_key(c).alias("key"), F.col("edge_id").alias("row_id"), F.col("confidence").alias("measure"), F.col("discovered_at").alias("at"))
        for t, c in EDGES
    ]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = eager.eager_join(*_edges(spark, sf_dir), k=3)
    halves = F.array(
        F.struct(F.lit(EDGES[0][0]).alias("edge_table"), F.col("left_best").alias("best")),
        F.struct(F.lit(EDGES[1][0]).alias("edge_table"), F.col("right_best").alias("best")),
    )
    rows = both.select("key", F.inline(halves)).select("edge_table", F.col("key").alias("key_name"), F.inline("best"))
    return rows.select("edge_table", "key_name", F.col("row_id").alias("edge_id"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per name: edges of both tables and the size and confidence product sum of their join, which is never built."""
    both = eager.eager_join(*_edges(spark, sf_dir), k=1).where("pairs > 0")
    return both.select(
        F.col("key").alias("key_name"),
        F.col("left_n").alias("n_dependencies"),
        F.col("right_n").alias("n_relationships"),
        "pairs",
        "measured_pairs",
        (F.floor(F.col("total_product") * 100 + F.lit("0.5").cast("decimal(2,1)")).cast("double") / 100).alias("confidence_product"),
    )


# Problem 3


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flat_items(table(spark, sf_dir, "brain_exports"), "export_id").select("export_id", "entity", "parent_pos", "pos", "item")


def p3_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat claim table of all exports."""
    fields = {"id": "id", "subject": "subject", "predicate": "predicate", "claim_object": "object", "status": "status", "created_at": "createdAt"}
    return nested.flat_table(table(spark, sf_dir, "brain_exports"), "export_id", "claim", fields)


#: The other flat tables: entity, and the fields of its records.
TABLES = {
    "p3_domains": ("domain", {"id": "id", "name": "name", "confidence": "confidence:double"}),
    "p3_entrypoints": ("entrypoint", {"id": "id", "framework": "framework", "file": "file", "confidence": "confidence:double"}),
    "p3_dependencies": ("dependency", {"id": "id", "source": "from", "target": "to", "type": "type", "confidence": "confidence:double"}),
    "p3_relationships": ("relationship", {"id": "id", "source": "source", "target": "target", "relationship": "relationship", "strength": "strength", "confidence": "confidence:double"}),
    "p3_architectures": ("architecture", {"id": "id", "pattern": "pattern", "confidence": "confidence:double"}),
    "p3_components": ("component", {"id": "id", "type": "type", "name": "name", "path": "path", "owner": "owner"}),
    "p3_evidence": ("evidence", {"id": "id", "kind": "kind", "locator": "locator", "epistemics": "epistemics"}),
}


def _flat(name: str) -> Callable[[SparkSession, str], DataFrame]:
    entity, fields = TABLES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.flat_table(table(spark, sf_dir, "brain_exports"), "export_id", entity, fields)

    query.__doc__ = f"The flat {entity} table of all exports."
    return query


p3_domains, p3_entrypoints, p3_dependencies, p3_relationships, p3_architectures, p3_components, p3_evidence = map(_flat, TABLES)


# Problem 4


def snapshot_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered snapshots with claim rows: project_id, snapshot_id, seq, next_snapshot, n_buckets."""
    rows = table(spark, sf_dir, "brain_claims").select(*[norm_key(c).alias(c) for c in IDS], norm_key("claim_id").alias("claim_id"))
    delivered = rows.dropna().groupBy(*IDS).agg(F.count(F.lit(1)).alias("n")).join(snapshots(spark, sf_dir), IDS)
    chain = Window.partitionBy("project_id").orderBy("created_at", "snapshot_id")
    total = F.sum("n").over(Window.partitionBy("project_id"))
    return delivered.select(
        *IDS,
        F.row_number().over(chain).alias("seq"),
        F.lead("snapshot_id").over(chain).alias("next_snapshot"),
        F.greatest(F.lit(1), F.ceil(total / ROWS_PER_BUCKET)).cast("int").alias("n_buckets"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = latest_claims(spark, sf_dir, status=norm_upper("status"), confidence=hundredths("confidence"))
    rows = claims.select(*IDS, "claim_id", F.struct("status", "confidence").alias("value"))
    chain = written(snapshot_chain(spark, sf_dir))
    found = snapdiff.snapshot_changes(rows, chain, "project_id", "snapshot_id", "claim_id", "value")
    return found.select("snapshot_id", "claim_id", "change_kind")


def p4_stale_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per snapshot whose content hash equals its predecessor's although claims changed: the counts of changes by kind."""
    meta = table(spark, sf_dir, "snapshot_meta").select(*[norm_key(c).alias(c) for c in (*IDS, "content_hash")], "created_at").dropna(subset=[*IDS, "created_at"])
    meta = meta.groupBy(*IDS).agg(F.min("created_at").alias("created_at"), F.max("content_hash").alias("content_hash"))
    chain = Window.partitionBy("project_id").orderBy("created_at", "snapshot_id")
    delivered = snapshot_chain(spark, sf_dir).select(*IDS)
    stale = meta.join(delivered, IDS).withColumn("before", F.lag("content_hash").over(chain)).where("content_hash = before")
    counts = p4_found(spark, sf_dir).groupBy("snapshot_id").agg(*[F.count_if(F.col("change_kind") == k).alias(f"n_{k}") for k in ("added", "removed", "changed")])
    return counts.join(stale.select("snapshot_id"), "snapshot_id")


# Problem 5

CLAIM = ["project_id", "claim_id"]
ATTRIBUTES = ["status", "superseded_by"]


def claim_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "claim_updates").select(
        *[norm_key(c).alias(c) for c in CLAIM],
        (norm_key("op") == "purge").alias("purge"),
        norm_upper("status").alias("status"),
        norm_key("superseded_by").alias("superseded_by"),
        "created_at",
        "invalidated_at",
        "updated_at",
        "loaded_at",
        "update_id",
    )
    closing = ~F.coalesce("purge", F.lit(False)) & F.col("status").isin("INVALIDATED", "SUPERSEDED")
    return updates.withColumn("eff", F.coalesce(F.when(closing, F.col("invalidated_at")), "updated_at", "created_at"))


def _history(spark: SparkSession, sf_dir: str, step: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """A step over the claims' change logs, with claims above the bound worked on in chunks."""
    parts = []
    for updates, chunked in zip(history.split_hot(claim_updates(spark, sf_dir), CLAIM), (False, True), strict=True):
        if updates is not None:
            events = history.effective_events(updates, CLAIM, "eff", "purge", ATTRIBUTES, ["loaded_at", "update_id"], chunked)
            parts.append(step(history.attribute_log(events, CLAIM, ATTRIBUTES, chunked), chunked))
    return reduce(DataFrame.unionByName, parts)


def _stamp(c: str):
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _history(spark, sf_dir, lambda log, chunked: history.versions(log, CLAIM, ATTRIBUTES, chunked))
    return found.select(*CLAIM, "status", _stamp("since").alias("valid_from"), _stamp("until").alias("valid_to"))


def p5_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals of each attribute on its own."""
    found = _history(spark, sf_dir, lambda log, chunked: history.attribute_intervals(log, CLAIM, chunked))
    return found.select(*CLAIM, "attribute", "value", _stamp("since").alias("valid_from"), _stamp("until").alias("valid_to"))
