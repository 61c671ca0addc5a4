"""Typed queries over the model, claim-store and event tables: one function per query, each over whole tables.

Ids, names and statuses compare trimmed and without case, as in the rest of the package. Edges count once per edge_id (of several rows
the one with the greatest loaded_at, then the greatest values).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions import ids, numbers, paths, text
from strataform.functions.clean import norm_key, norm_keys, norm_upper, strip
from strataform.operators import architecture, claims, delta, edges, exclusions, findings, graph, matching, nested
from strataform.operators.resolve import resolve
from strataform.operators.skew import join_dimension
from strataform.plans.store import IDS, latest_claims, snapshot_chain, snapshots
from strataform.sources.shared import written
from strataform.sources.tables import table

P = "project_id"


def _joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


# Model tables


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "dependency_matches").where("edge_id is not null")
    row = F.struct("loaded_at", norm_key(P).alias(P), norm_key("dep_from").alias("source"), norm_key("dep_to").alias("target"), norm_key("dep_type").alias("type"), "confidence", "evidence")
    once = t.groupBy("edge_id").agg(F.max(row).alias("r"))
    return once.select("edge_id", f"r.{P}", "r.source", "r.target", "r.type", "r.confidence", "r.evidence").dropna(subset=[P, "source", "target"])


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "relationship_matches").where("edge_id is not null")
    row = F.struct(
        "loaded_at",
        norm_key(P).alias(P),
        norm_key("rel_source").alias("source"),
        norm_key("rel_target").alias("target"),
        norm_upper("relationship").alias("kind"),
        norm_key("strength").alias("strength"),
        "bidirectional",
        "confidence",
        "evidence",
        # In its own case, for what splits it into words.
        strip("rel_target").alias("target_name"),
    )
    once = t.groupBy("edge_id").agg(F.max(row).alias("r"))
    return once.select("edge_id", "r.*").drop("loaded_at").dropna(subset=[P, "source", "target"])


def exported(spark: SparkSession, sf_dir: str, entity: str, **fields: str) -> DataFrame:
    """A collection of the exports with the project of its export."""
    exports = table(spark, sf_dir, "brain_exports")
    flat = nested.flat_table(exports, "export_id", entity, fields)
    return flat.join(exports.select("export_id", norm_key(P).alias(P)), "export_id")


def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each project that its evidence points at: project_id, path."""
    t = table(spark, sf_dir, "brain_evidence").select(norm_key(P).alias(P), F.col("locator").alias("path"))
    return t.where("path is not null and path <> ''").dropna().distinct()


# Findings, from events


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    some = F.array(F.lit("claude-code"), F.lit("codex"), F.lit("cursor"))
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("repo"),
        F.col("event_id").alias("finding_id"),
        kind.alias("rule_id"),
        F.when(kind.isin("error", "login"), "security").when(kind == "purchase", "mcp").otherwise("context").alias("category"),
        F.when(kind == "error", "critical").when(kind == "purchase", "warning").otherwise("info").alias("severity"),
        F.concat_ws(":", F.col("user_id").cast("string"), kind, k.cast("string")).alias("path"),
        F.slice(some, 1, F.pmod(k, F.lit(4))).alias("agents"),
        "ts",
    )


def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summarize(event_findings(spark, sf_dir), ["repo"])


def finding_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = findings.dedupe(event_findings(spark, sf_dir), ["repo", "rule_id", "path"], "finding_id")
    return out.withColumn("agents", _joined("agents"))


def readiness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.scores(event_findings(spark, sf_dir).withColumn("day", F.to_date("ts")), ["repo", "day"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def readiness_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.scopes(event_findings(spark, sf_dir), "repo")


#: The findings up to this time are the baseline.
BASELINE = "2024-01-16"


def policy_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four gates: a least score of 30, critical findings, findings of two rules, findings that the baseline lacks."""
    f = event_findings(spark, sf_dir)
    both = findings.scores(f, ["repo"]).join(findings.summarize(f, ["repo"]), "repo")
    late = F.col("ts") >= F.lit(BASELINE).cast("timestamp")
    news = findings.compare(f.where(~late).withColumn("id", F.struct("repo", "path")), f.where(late).withColumn("id", F.struct("repo", "path")), "id")
    news = news.where("status = 'new'").groupBy(F.col("id.repo").alias("repo")).agg(F.count(F.lit(1)).alias("n_new"))
    told = f.groupBy("repo").agg(F.count_if(F.col("rule_id").isin("login", "purchase")).alias("n_ruled"), (F.max(F.size("agents")) == 0).alias("limited"))
    return findings.gates(both.join(told, "repo").join(news, "repo", "left"), "repo", 30, "critical", fail_on_new=True)


def finding_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_findings(spark, sf_dir)
    late = F.col("ts") >= F.lit(BASELINE).cast("timestamp")
    return findings.compare(f.where(~late), f.where(late), "path")


# Edges


def dependency_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.merge_dependencies(dependencies(spark, sf_dir), [P]).withColumn("evidence", _joined("evidence"))


def relationship_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.merge_relationships(relationships(spark, sf_dir), [P]).withColumn("evidence", _joined("evidence"))


def fan_in_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.fan_in(dependencies(spark, sf_dir), [P])


def coupling_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.coupling(relationships(spark, sf_dir), [P])


def risks(spark: SparkSession, sf_dir: str, rules: DataFrame | None = None) -> DataFrame:
    """All risks of each project, each target once per kind: kind, target, severity, confidence.

    Entrypoints and domains are those of all its exports; of an entrypoint told more than once the greatest confidence counts, none counts
    as 0. Ownership is unclear where no rule covers an entrypoint or one of a domain's first three paths.
    """
    row = lambda df, kind, severity, sure: df.select(P, F.lit(kind).alias("kind"), "target", F.lit(severity).alias("severity"), sure.alias("confidence"))
    files = exported(spark, sf_dir, "entrypoint", file="file", confidence="confidence").where("file <> ''").dropna(subset=[P])
    sure = F.nanvl(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)), F.lit(0.0))
    entries = files.groupBy(P, F.col("file").alias("target")).agg(F.max(sure).alias("sure"))
    exports = table(spark, sf_dir, "brain_exports")
    of = exports.select("export_id", norm_key(P).alias(P))
    domain_paths = nested.flat_items(exports, "export_id").where("entity = 'domain_path' and pos < 3 and item <> ''").join(of, "export_id").select(P, F.col("item").alias("target"))
    owned = files.select(P, F.col("file").alias("target")).unionByName(domain_paths).dropna()
    owned = owned.withColumn("target", F.replace("target", F.lit("\\"), F.lit("/"))).distinct().withColumn("path", F.regexp_replace("target", r"\A/+", ""))
    covered = matching.resolve_owners(owned.select(P, "path"), owner_rules(spark, sf_dir) if rules is None else rules, [P]).where("owner is not null")
    unowned = owned.join(covered.select(P, "path"), [P, "path"], "left_anti")
    disputed = architecture.conflicts(_signals(spark, sf_dir), P).withColumnRenamed("pattern", "target").dropna(subset=[P])
    kinds = [
        row(entries, "critical-entrypoint", "high", numbers.confidence(F.least(F.lit(0.9), F.lit(0.55) + F.col("sure") * 0.35))),
        fan_in_risk(spark, sf_dir).select(P, F.lit("dependency-centrality").alias("kind"), "target", "severity", "confidence"),
        coupling_risk(spark, sf_dir).select(P, F.lit("high-coupling").alias("kind"), "target", "severity", "confidence"),
        row(disputed, "architecture-conflict", "medium", numbers.confidence(F.least(F.lit(0.85), F.lit(0.4) + F.col("n") * 0.1))),
        row(unowned, "unclear-ownership", "medium", F.lit(0.7)),
    ]
    return reduce(DataFrame.unionByName, kinds).where("confidence >= 0.5")


def top_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five gravest risks of each project among those of all kinds."""
    rank = numbers.rank_of(F.col("severity"), numbers.RISK_LEVELS)
    order = Window.partitionBy(P).orderBy(rank.desc(), F.col("confidence").desc(), "kind", "target")
    ranked = risks(spark, sf_dir).withColumn("place", F.row_number().over(order)).where("place <= 5")
    return ranked.select(P, "place", "kind", "target", "severity", "confidence")


def risk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five gravest of the risks that edges tell, fan-in and coupling: severity, confidence, kind, target. Those of all kinds are in ``top_risks``."""
    kinds = [fan_in_risk(spark, sf_dir).withColumn("kind", F.lit("dependency-centrality")), coupling_risk(spark, sf_dir).withColumn("kind", F.lit("high-coupling"))]
    rank = numbers.rank_of(F.col("severity"), numbers.RISK_LEVELS)
    order = Window.partitionBy(P).orderBy(rank.desc(), F.col("confidence").desc(), "kind", "target")
    ranked = kinds[0].unionByName(kinds[1]).withColumn("place", F.row_number().over(order)).where("place <= 5")
    return ranked.select(P, "place", "kind", "target", "severity", "confidence")


def bidirectional_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = written(edges.merge_relationships(relationships(spark, sf_dir), [P]))
    return edges.mark_bidirectional(merged.withColumn("bidirectional", F.lit(False)), [P]).select(P, "source", "target", "kind", "bidirectional")


def edge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships of some kinds between controllers and services, and dependencies told by injection."""
    r = relationships(spark, sf_dir).where(edges.matching(["USES", "CALLS"], ["Controller"], ["Service", "Repository"]))
    d = dependencies(spark, sf_dir).where(edges.matching(["import", "require"], evidence=["injects"], kind="type"))
    found = r.select(F.lit("relationship").alias("collection"), P, "edge_id").unionByName(d.select(F.lit("dependency").alias("collection"), P, "edge_id"))
    return found


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project: edges of both kinds, evidence strings, mean confidence over both."""
    rows = [d.select(P, "confidence", F.coalesce(F.size("evidence"), F.lit(0)).alias("e"), F.lit(k).alias("k")) for k, d in enumerate((dependencies(spark, sf_dir), relationships(spark, sf_dir)))]
    all_rows = rows[0].unionByName(rows[1])
    return all_rows.groupBy(P).agg(
        F.count_if(F.col("k") == 0).alias("n_dependencies"),
        F.count_if(F.col("k") == 1).alias("n_relationships"),
        F.sum(F.greatest("e", F.lit(0))).cast("long").alias("n_evidence"),
        numbers.mean_confidence(F.col("confidence")).alias("confidence"),
    )


def list_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project the envelope of the list: count, mean confidence, the first 20 evidence strings in edge order."""
    d = dependencies(spark, sf_dir)
    # Twenty strings need twenty edges with evidence at most; the group limit keeps them per task before the shuffle.
    order = Window.partitionBy(P).orderBy("edge_id")
    told = d.where(F.size("evidence") > 0).withColumn("place", F.row_number().over(order)).where("place <= 20")
    heads = told.groupBy(P).agg(F.sort_array(F.collect_list(F.struct("place", "evidence"))).alias("l"))
    heads = heads.select(P, _joined(F.slice(F.flatten(F.transform("l", lambda x: x["evidence"])), 1, 20)).alias("evidence"))
    counts = d.groupBy(P).agg(F.count(F.lit(1)).alias("n"), numbers.mean_confidence(F.col("confidence")).alias("confidence"))
    return counts.join(heads, P, "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))


def find_component(spark: SparkSession, sf_dir: str, name: str = "CoreRegistry") -> DataFrame:
    """The edges at which a component stands, by slice."""
    low = name.lower()
    r, d = relationships(spark, sf_dir), dependencies(spark, sf_dir)
    at = lambda df, where, label: df.where(where).select(P, F.lit(label).alias("slice"), "edge_id")
    return (
        at(r, F.col("source") == low, "relationship-source")
        .unionByName(at(r, F.col("target") == low, "relationship-target"))
        .unionByName(at(d, (F.col("source") == low) | (F.col("target") == low), "dependency-endpoint"))
    )


def find_dependency(spark: SparkSession, sf_dir: str, target: str = "EventSpine", kind: str = "import") -> DataFrame:
    """The first matching dependency of each project: confidence descending, then names, then id."""
    found = dependencies(spark, sf_dir).where((F.col("target") == target.lower()) & (F.col("type") == kind))
    order = Window.partitionBy(P).orderBy(F.col("confidence").desc_nulls_last(), "source", "target", "edge_id")
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").select(P, "edge_id", "source", "target", "type", "confidence")


def find_relationship(spark: SparkSession, sf_dir: str, target: str = "StorageHub", kind: str = "CONTAINS") -> DataFrame:
    found = relationships(spark, sf_dir).where((F.col("target") == target.lower()) & (F.col("kind") == kind))
    order = Window.partitionBy(P).orderBy(F.col("confidence").desc_nulls_last(), "source", "target", "edge_id")
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").select(P, "edge_id", "source", "target", "kind", "confidence")


def evidence_search(spark: SparkSession, sf_dir: str, needle: str = "injects") -> DataFrame:
    """Per project the records of any collection that hold a text, and how sure that makes: edges by their evidence, exported domains by
    their paths, architectures by their rules, entrypoints by their file."""
    holds = lambda df: df.where(F.exists("evidence", lambda e: F.contains(F.lower(e), F.lit(needle.lower())))).select(P)
    exports = table(spark, sf_dir, "brain_exports")
    of = exports.select("export_id", norm_key(P).alias(P)).dropna()
    items = nested.flat_items(exports, "export_id").where(F.col("entity").isin("domain_path", "architecture_rule") & F.contains(F.lower("item"), F.lit(needle.lower())))
    told = items.select("export_id", "entity", "parent_pos").distinct().join(of, "export_id").select(P)
    files = exported(spark, sf_dir, "entrypoint", file="file").where(F.contains(F.lower("file"), F.lit(needle.lower()))).select(P).dropna()
    hits = reduce(DataFrame.unionByName, [holds(dependencies(spark, sf_dir)), holds(relationships(spark, sf_dir)), told, files])
    n = F.count(F.lit(1))
    return hits.groupBy(P).agg(n.alias("n"), numbers.js_round(F.least(F.lit(0.99), F.lit(0.5) + F.least(n, F.lit(10)) * 0.04)).alias("confidence"))


def path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of any collection that hold a directory's name."""
    return evidence_search(spark, sf_dir, "harbor")


def find_domain(spark: SparkSession, sf_dir: str, name: str = "Inventory") -> DataFrame:
    """project_id, slice, item: the exports' domains of a name with what belongs to them in their project.

    entrypoint: files that hold one of the domain's paths or lie in one; relationship and dependency: edges that name the domain or have it
    or (relationships) one of its paths in their evidence; architecture: patterns with a rule that names it, else the first three.
    """
    low = name.lower()
    named = exported(spark, sf_dir, "domain", id="id", name="name").where(F.lower("name") == low).dropna(subset=[P])
    exports = table(spark, sf_dir, "brain_exports")
    items = nested.flat_items(exports, "export_id")
    paths_of = items.where("entity = 'domain_path' and item <> ''").select("export_id", F.col("parent_pos").alias("pos"), "item")
    # One row per project: the paths of one domain are as many as its exports list.
    scope = named.join(paths_of, ["export_id", "pos"], "left").groupBy(P).agg(F.collect_set(F.lower("item")).alias("paths"))
    within = lambda df: join_dimension(df, scope, [P], df.columns[-1])
    either = lambda c: F.exists("paths", lambda p: F.contains(p, F.lower(c)) | F.contains(F.lower(c), p))
    row = lambda df, kind, item: df.select(P, F.lit(kind).alias("slice"), item.cast("string").alias("item"))
    entries = exported(spark, sf_dir, "entrypoint", file="file").select(P, "file").dropna().distinct()
    r, d = relationships(spark, sf_dir).drop("bidirectional"), dependencies(spark, sf_dir)
    holds = lambda text: F.exists(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.contains(F.lower(e), text))
    own = (F.col("source") == low) | (F.col("target") == low) | holds(F.lit(low))
    on_path = F.exists("paths", lambda p: F.contains("source", p) | F.contains("target", p) | F.exists(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.contains(F.lower(e), p)))
    archs = exported(spark, sf_dir, "architecture", pattern="pattern")
    rules_ = items.where((F.col("entity") == "architecture_rule") & F.contains(F.lower("item"), F.lit(low))).select("export_id", F.col("parent_pos").alias("pos")).distinct()
    naming = archs.join(rules_, ["export_id", "pos"]).select(P, "pattern").dropna().distinct()
    first = archs.join(naming.select(P).distinct(), P, "left_anti").where("pos < 3").select(P, "pattern").dropna().distinct()
    parts = [
        row(scope, "domain", F.lit(name)),
        row(within(entries).where(either("file")), "entrypoint", F.col("file")),
        row(within(r.select(P, "source", "target", "evidence", "edge_id")).where(own | on_path), "relationship", F.col("edge_id")),
        row(within(d.select(P, "source", "target", "evidence", "edge_id")).where(own), "dependency", F.col("edge_id")),
        row(within(naming.unionByName(first)), "architecture", F.col("pattern")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def impact(spark: SparkSession, sf_dir: str, needle: str = "Kernel") -> DataFrame:
    """One step around a name: edges with the text in either end, by end."""
    low = needle.lower()
    d = dependencies(spark, sf_dir).withColumns({"s": F.contains("source", F.lit(low)), "t": F.contains("target", F.lit(low))}).where("s or t")
    return d.groupBy(P).agg(F.count_if("t").alias("n_inbound"), F.count_if("s").alias("n_outbound"), F.count(F.lit(1)).alias("n_edges"))


def _frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exported(spark, sf_dir, "entrypoint", framework="framework", file="file").dropna(subset=[P])


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exported(spark, sf_dir, "domain", id="id", name="name").dropna(subset=[P])


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return architecture.signals(relationships(spark, sf_dir), dependencies(spark, sf_dir), _frameworks(spark, sf_dir), _domains(spark, sf_dir), P)


def architecture_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project the count of every signal over its edges."""
    names = [*architecture.RELATIONSHIP_SIGNALS, *architecture.DEPENDENCY_SIGNALS]
    return _signals(spark, sf_dir).select(P, *[F.col(n).cast("long").alias(n) for n in names])


def architecture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return architecture.infer(_signals(spark, sf_dir), P)


def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type of dependency: count, least, greatest, mean and exact median."""
    d = dependencies(spark, sf_dir).where("confidence is not null")
    return d.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("confidence").alias("least"),
        F.max("confidence").alias("greatest"),
        numbers.mean_confidence(F.col("confidence")).alias("mean"),
        numbers.js_round(F.percentile("confidence", F.lit(0.5))).alias("median"),
    )


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank p50, p95 and maximum of an event's value by type.

    A histogram of the values, combined before its shuffle, is cut at whole numbers and counted up bucket by bucket, so no task
    holds the values of a type.
    """
    e = table(spark, sf_dir, "events").where("value is not null")
    seen = e.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("k")).withColumn("bucket", F.floor("value"))
    inside = Window.partitionBy("event_type", "bucket").orderBy("value")
    buckets = seen.groupBy("event_type", "bucket").agg(F.sum("k").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("event_type").orderBy("bucket")) - F.col("in_bucket")
    total = F.sum("in_bucket").over(Window.partitionBy("event_type"))
    placed = seen.join(buckets.select("event_type", "bucket", before.alias("before"), total.alias("n")), ["event_type", "bucket"])
    upto = placed.withColumn("upto", F.col("before") + F.sum("k").over(inside))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p), F.col("value")))
    return upto.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("value").alias("greatest"), F.max("n").alias("n"))


def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered against delivered snapshots of each project: precision, recall, F1."""
    truth = snapshots(spark, sf_dir).select(*IDS)
    actual = table(spark, sf_dir, "brain_claims").select(*[norm_key(c).alias(c) for c in IDS])
    return matching.set_metrics(truth, actual, [P], "snapshot_id")


# Files and texts


def token_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project and domain of the lexicon: files, token hits, confidence."""
    lexicon = {w: d for d, ws in reversed(paths.DOMAIN_LEXICON.items()) for w in ws}
    rows = [(w, d) for w, d in sorted(lexicon.items())]
    words = locators(spark, sf_dir).select(P, "path", F.explode(paths.tokens(F.col("path"))).alias("word"))
    hits = words.join(F.broadcast(spark.createDataFrame(rows, "word string, domain string")), "word")
    per_file = hits.groupBy(P, "domain", "path").agg(F.count(F.lit(1)).alias("n"))
    counts = per_file.groupBy(P, "domain").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_hits"))
    return counts.withColumn("confidence", numbers.domain_confidence(F.col("n_files"), F.col("n_hits"))).where("confidence >= 0.5")


def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project and role: files, samples and sources among them."""
    f = locators(spark, sf_dir).withColumns({"role": F.coalesce(paths.role(F.col("path")), F.lit("none")), "s": paths.is_sample_path(F.col("path")), "c": paths.is_source(F.col("path"))})
    return f.groupBy(P, "role").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("s").alias("n_samples"), F.count_if("c").alias("n_sources"))


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names read off every distinct path: stem in Pascal case, feature, directory, extension."""
    p = F.col("path")
    f = locators(spark, sf_dir).select("path").distinct()
    return f.select(
        "path", paths.pascal_case(paths.stem(paths.basename(p))).alias("name"), F.coalesce(paths.feature_name(p), F.lit("")).alias("feature"), paths.dirname(p).alias("directory"), paths.extension(p).alias("extension")
    )


def model_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the distinct paths as entrypoints."""
    return locators(spark, sf_dir).select("path").distinct().select("path", ids.model_id("entrypoint-discovery", "entrypoint", F.col("path")).alias("id"))


def claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the distinct facts, by the 32-bit hash."""
    t = table(spark, sf_dir, "brain_claims").select("subject", "predicate", "claim_object").dropna().distinct()
    return t.withColumn("id", ids.claim_id(F.col("subject"), F.col("predicate"), F.col("claim_object")))


def redacted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct locators and symbols of the evidence as they may be stored."""
    t = table(spark, sf_dir, "brain_evidence").select("locator", "symbol").distinct()
    return t.select("locator", "symbol", text.redact_locator(F.col("locator")).alias("safe_locator"), text.redact_symbol(F.col("symbol")).alias("safe_symbol"))


def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.duplicate_classes(table(spark, sf_dir, "documents").where("doc_id is not null"), [], "doc_id", "text")


def large_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the size of their text in bytes: 8 KiB and more are large, 16 KiB and more very large."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return d.withColumn("severity", paths.size_class(F.col("n_bytes"), 4 << 10, 8 << 10)).where("severity is not null")


#: A line of an owners file inside a note: a rooted path and who owns it.
OWNER_LINE = r"(?m)^(/\S+)[ \t]+(@\S+)[ \t]*\r?$"


def owner_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, pattern, owner, source: the owners' lines in a project's notes, and the owners its claims tell of directories."""
    d = table(spark, sf_dir, "documents").select(norm_key(P).alias(P), "text").dropna()
    found = lambda i: F.regexp_extract_all("text", F.lit(OWNER_LINE), F.lit(i))
    lines = d.select(P, F.inline(F.arrays_zip(found(1).alias("pattern"), found(2).alias("owner")))).withColumn("source", F.lit("codeowners"))
    c = table(spark, sf_dir, "brain_claims").where(norm_key("predicate") == "owned-by")
    told = c.select(norm_key(P).alias(P), strip("subject").alias("pattern"), strip("claim_object").alias("owner"), F.lit("package").alias("source"))
    return lines.unionByName(told).where("pattern <> '' and owner <> ''").dropna().distinct()


def ownership_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of every path of every project by the project's own rules; null where none covers it."""
    return matching.resolve_owners(locators(spark, sf_dir), owner_rules(spark, sf_dir), [P])


def unclear_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that no rule of their project covers."""
    return ownership_resolution(spark, sf_dir).where("owner is null").select(P, "path")


#: Agents in the order in which their patterns are dealt out.
IGNORING = ["claude-code", "codex", "cursor"]


def agent_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, agent, ord, pattern, keep: the ignore patterns that evidence of kind pattern-match stands for.

    The tables have no ignore files, so a locator's length decides which agent ignores it and whether as its directory, its extension, a
    rooted path, a name, or as a path taken back in.
    """
    t = table(spark, sf_dir, "brain_evidence").where(norm_key("kind") == "pattern-match")
    t = t.select(norm_key(P).alias(P), F.col("locator").alias("ord")).where("ord <> ''").dropna().distinct().withColumn("n", F.octet_length("ord"))
    p = F.col("ord")
    shape = F.floor(F.col("n") / 3) % 5
    folder = F.when(paths.dirname(p) != "", F.concat(paths.dirname(p), F.lit("/"))).otherwise(p)
    pattern = F.when(shape == 0, folder).when(shape == 1, F.concat(F.lit("*."), paths.extension(p))).when(shape == 2, F.concat(F.lit("/"), p)).when(shape == 3, paths.basename(p)).otherwise(p)
    agent = F.element_at(F.array(*[F.lit(a) for a in IGNORING]), (F.col("n") % 3).cast("int") + 1)
    return t.select(P, agent.alias("agent"), "ord", pattern.alias("pattern"), (shape == 4).alias("keep"))


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per path of a project the agents with patterns there that may read it."""
    out = exclusions.exposure(locators(spark, sf_dir), agent_patterns(spark, sf_dir), [P])
    return out.select(P, "path", _joined("agents").alias("agents"))


def import_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import specifiers in the texts: project_id, path, specifier, distinct.

    The language is that of the path's extension; texts that are no source, such as notes, and texts without a path are read as scripts.
    The latter keep a null path.
    """
    d = table(spark, sf_dir, "documents").select(norm_key(P).alias(P), F.when(F.trim("path") != "", F.col("path")).alias("path"), "text").dropna(subset=[P, "text"])
    language = F.when(paths.is_source(F.col("path")), paths.extension(F.col("path"))).otherwise("ts")
    return d.select(P, "path", F.explode(text.references(F.col("text"), language)).alias("specifier")).distinct()


def project_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports in the texts of each project and the file of the project each means: project_id, path, specifier, target ('' if there is none).

    A relative specifier is read from the directory of its own path; without a path it has no target.
    """
    refs = import_references(spark, sf_dir).withColumnsRenamed({"path": "own"}).withColumn("path", F.coalesce("own", F.lit("")))
    found = resolve(refs, locators(spark, sf_dir), [P])
    placed = F.col("own").isNotNull() | ~F.col("specifier").startswith(".")
    return found.select(P, F.col("own").alias("path"), "specifier", F.when(placed & F.col("target").isNotNull(), F.col("target")).otherwise("").alias("target"))


def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search across projects: script imports in texts and the file each would mean among those of all projects, read from the root.

    The imports of each project, resolved in their place, are in ``project_imports``.
    """
    d = table(spark, sf_dir, "documents").where("text is not null")
    refs = d.select(F.explode(text.references(F.col("text"), F.lit("ts"))).alias("specifier")).distinct().withColumn("path", F.lit("root.ts"))
    found = resolve(refs, locators(spark, sf_dir), [], with_ends=False)
    return found.select("specifier", F.coalesce("target", F.lit("")).alias("target"))


def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in back-ticks or links of a text that are no file or directory of the project."""
    d = table(spark, sf_dir, "documents").select(norm_key(P).alias(P), F.coalesce("path", F.lit("")).alias("path"), "text").dropna()
    refs = d.select(P, "path", F.explode(text.local_references(F.col("text"))).alias("ref")).distinct()
    return matching.missing_references(text.reference_tries(refs), locators(spark, sf_dir), [P])


# Claims


def stored_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_claims(
        spark,
        sf_dir,
        subject=F.col("subject"),
        predicate=F.col("predicate"),
        claim_object=F.col("claim_object"),
        status=norm_upper("status"),
        superseded_by=norm_key("superseded_by"),
        confidence=F.col("confidence"),
        evidence_ids=norm_keys("evidence_ids"),
    )


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.contradictions(stored_claims(spark, sf_dir), IDS)


def claim_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step between every two neighbouring snapshots of every project, all steps at once."""
    chain = written(snapshot_chain(spark, sf_dir).select(*IDS, "seq", "next_snapshot"))
    rows = join_dimension(stored_claims(spark, sf_dir).drop("evidence_ids"), chain, IDS, "claim_id")
    live = rows.where("status = 'ACTIVE' and seq > 1").drop("seq", "next_snapshot")
    before = rows.where("next_snapshot is not null").withColumn("snapshot_id", F.col("next_snapshot")).drop("seq", "next_snapshot")
    return claims.lifecycle(before, live, IDS).select(*IDS, "claim_id", "status", "superseded_by")


def stored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "brain_evidence").select(*[norm_key(c).alias(c) for c in (*IDS, "evidence_id")], "locator").dropna(subset=[*IDS, "evidence_id"])


def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.explain(stored_claims(spark, sf_dir), stored_evidence(spark, sf_dir), IDS)


def claim_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim with the evidence it names (asked, found, locators), without any too, and the contradictions that name it."""
    found = claims.explain(stored_claims(spark, sf_dir), stored_evidence(spark, sf_dir), IDS)
    t = table(spark, sf_dir, "brain_contradictions").select(*[norm_key(c).alias(c) for c in (*IDS, "contradiction_id")], F.explode(norm_keys("claim_ids")).alias("claim_id"))
    told = t.dropna().groupBy(*IDS, "claim_id").agg(_joined(F.array_sort(F.collect_set("contradiction_id"))).alias("contradictions"))
    every = stored_claims(spark, sf_dir).select(*IDS, "claim_id").join(found, [*IDS, "claim_id"], "left").join(told, [*IDS, "claim_id"], "left")
    return every.na.fill(0, ["n_asked", "n_found"]).na.fill("", ["locators", "contradictions"])


def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.links(stored_claims(spark, sf_dir), IDS)


def brain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per snapshot: live claims, all claims, mean confidence over all."""
    c = stored_claims(spark, sf_dir)
    return c.groupBy(*IDS).agg(F.count_if(F.col("status") == "ACTIVE").alias("n_active"), F.count(F.lit(1)).alias("n_claims"), numbers.mean_confidence(F.col("confidence")).alias("confidence"))


def list_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that count as standing: ACTIVE and CONTRADICTED."""
    return stored_claims(spark, sf_dir).where("status in ('ACTIVE', 'CONTRADICTED')").select(*IDS, "claim_id", "status", "confidence")


def invalidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_claims(spark, sf_dir).where("status = 'INVALIDATED'").select(*IDS, "claim_id")


def contradiction_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions that are new, gone, changed or the same from snapshot to snapshot."""
    chain = written(snapshot_chain(spark, sf_dir).select(*IDS, "seq", "next_snapshot"))
    t = table(spark, sf_dir, "brain_contradictions").select(*[norm_key(c).alias(c) for c in (*IDS, "contradiction_id")], "confidence")
    t = t.dropna(subset=[*IDS, "contradiction_id"]).groupBy(*IDS, "contradiction_id").agg(F.max("confidence").alias("confidence"))
    t = join_dimension(t, chain, IDS, "contradiction_id")
    before = t.where("next_snapshot is not null").select(P, F.col("next_snapshot").alias("snapshot_id"), "contradiction_id", "confidence")
    return delta.keyed_delta(before, t.where("seq > 1"), [*IDS, "contradiction_id"], ["confidence"])


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw claim rows that break the contract, by rule: absent fields, unknown status, confidence out of range, id used twice in a snapshot."""
    c = table(spark, sf_dir, "brain_claims")
    status = norm_upper("status")
    each = F.array(
        F.struct(F.lit("absent field").alias("rule"), (F.col("subject").isNull() | F.col("predicate").isNull() | F.col("claim_object").isNull() | status.isNull()).alias("breaks")),
        F.struct(F.lit("unknown status").alias("rule"), (status.isNotNull() & ~status.isin(claims.STATUSES)).alias("breaks")),
        F.struct(F.lit("confidence").alias("rule"), (F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("breaks")),
    )
    rows = c.select(F.explode(each).alias("x")).where("x.breaks").groupBy(F.col("x.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    twice = c.groupBy(*[norm_key(x) for x in (*IDS, "claim_id")]).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return rows.unionByName(twice.agg(F.count(F.lit(1)).alias("n")).select(F.lit("id used twice").alias("rule"), "n"))


def snapshot_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered snapshots in order, each with its place and whether any registration's content hash equals one of its predecessor's."""
    t = table(spark, sf_dir, "snapshot_meta").select(*[norm_key(c).alias(c) for c in (*IDS, "content_hash")], "created_at").dropna(subset=[*IDS, "created_at"])
    once = t.groupBy(*IDS).agg(F.min("created_at").alias("created_at"), F.max("content_hash").alias("content_hash"))
    w = Window.partitionBy(P).orderBy("created_at", "snapshot_id")
    same = F.coalesce(F.col("content_hash") == F.lag("content_hash").over(w), F.lit(False))
    return once.select(*IDS, F.row_number().over(w).alias("place"), same.alias("same_hash"))


# Traces


def _roots(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dependencies(spark, sf_dir).select(P).distinct().withColumn("node", F.lit(name.lower()))


def trace_dependents(spark: SparkSession, sf_dir: str, root: str = "EventSpine") -> DataFrame:
    """Everything in each project that leads to a component, with the least number of steps."""
    return graph.reach(dependencies(spark, sf_dir), _roots(spark, sf_dir, root), [P], "dependents").select(P, "node", "depth")


def blast_radius(spark: SparkSession, sf_dir: str, root: str = "SharedKernel") -> DataFrame:
    return graph.reach(dependencies(spark, sf_dir), _roots(spark, sf_dir, root), [P], "blast-radius").select(P, "node", "depth")


def trace_dependencies(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Everything that a component of each project leads to; without a root from the project's first component by name."""
    d = dependencies(spark, sf_dir)
    roots = d.groupBy(P).agg(F.min("source").alias("node")) if root is None else _roots(spark, sf_dir, root)
    return graph.reach(d, roots, [P], "dependencies").select(P, "root", "node", "depth")


def trace_confidence(spark: SparkSession, sf_dir: str, root: str = "EventSpine") -> DataFrame:
    """Per project of a dependents trace: nodes, edges walked (each source, target and type once, the surest), mean confidence."""
    d = dependencies(spark, sf_dir)
    nodes = graph.reach(d, _roots(spark, sf_dir, root), [P], "dependents").select(P, F.col("node").alias("target"))
    edges_ = d.groupBy(P, "source", "target", "type").agg(F.max("confidence").alias("confidence")).join(nodes, [P, "target"])
    walked = edges_.groupBy(P).agg(F.count(F.lit(1)).alias("n_edges"), numbers.mean_confidence(F.col("confidence")).alias("confidence"))
    counts = nodes.groupBy(P).agg(F.count(F.lit(1)).alias("n_nodes"))
    return counts.join(walked, P, "left").na.fill(0, ["n_edges"]).na.fill(0.0, ["confidence"])


def _segments_hold(path: Column, target: str) -> Column:
    """A path is the target, or has it as whole segments."""
    t = target.replace("\\", "/").lower()
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    around = F.concat(F.lit("/"), p, F.lit("/"))
    return (p == t) | F.contains(around, F.lit(f"/{t}/")) if len(t) > 1 else p == t


def entrypoint_downstream(spark: SparkSession, sf_dir: str, target: str = "harbor") -> DataFrame:
    """project_id, kind, item, confidence: the entrypoints below a path, and what the dependencies that name it lead to."""
    d = dependencies(spark, sf_dir)
    files = exported(spark, sf_dir, "entrypoint", file="file", confidence="confidence:double").where("file <> ''").dropna(subset=[P])
    entries = files.where(_segments_hold(F.col("file"), target)).groupBy(P, F.col("file").alias("item")).agg(F.max("confidence").alias("confidence"))
    named = d.where(_segments_hold(F.col("source"), target) | _segments_hold(F.col("target"), target))
    roots = named.select(P, F.explode(F.array("source", "target")).alias("node")).distinct()
    reached = graph.reach(d, roots, [P], "dependencies").select(P, F.col("node").alias("item")).distinct()
    return entries.select(P, F.lit("entrypoint").alias("kind"), "item", "confidence").unionByName(reached.select(P, F.lit("component").alias("kind"), "item", F.lit(None).cast("double").alias("confidence")))


def mutual_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dependencies(spark, sf_dir)
    r = relationships(spark, sf_dir)
    return graph.two_cycles(d.select(P, "source", "target").unionByName(r.select(P, "source", "target")), [P])


def domain_modules(spark: SparkSession, sf_dir: str, target: str | None = None) -> DataFrame:
    """Two levels: the domains a project exported and the components whose path lies in or below the directory of one of a domain's paths.

    With a target only domains of that name, or with a path that has it as whole segments.
    """
    exports = table(spark, sf_dir, "brain_exports").withColumn(P, norm_key(P))
    of = exports.select("export_id", P)
    items = nested.flat_items(exports, "export_id").where("entity = 'domain_path'").select("export_id", F.col("parent_pos").alias("pos"), "item")
    names = nested.flat_table(exports, "export_id", "domain", {"name": "name"})
    if target is not None:
        hits = items.where(_segments_hold(F.col("item"), target)).select("export_id", "pos").unionByName(names.where(F.lower("name") == target.lower()).select("export_id", "pos")).distinct()
        items = items.join(hits, ["export_id", "pos"], "left_semi")
    dirs = items.select("export_id", "pos", paths.dirname(F.col("item")).alias("directory")).where("directory <> ''")
    parts = nested.flat_table(exports, "export_id", "component", {"component": "name", "path": "path"})
    below = parts.join(of, "export_id").select(P, "component", F.explode(paths.ancestors(F.col("path"))).alias("directory")).distinct()
    owned = names.join(dirs, ["export_id", "pos"]).join(of, "export_id").select(P, F.col("name").alias("domain"), "directory").distinct()
    return owned.join(below, [P, "directory"]).select(P, "domain", "component").dropna().distinct()


def built_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, claim_id, subject, predicate, claim_object, source_pass, confidence: the claims that the model of each project makes.

    Domains, entrypoints and architectures come from its exports, dependencies and relationships from its merged edges, owners from its
    rules, risks from those of all kinds. A fact told twice is one claim with the greatest confidence, clamped and at two decimals.
    """
    row = lambda df, source, subject, predicate, claim_object, sure: df.select(
        P, F.lit(source).alias("source_pass"), subject.alias("subject"), predicate.alias("predicate"), claim_object.alias("claim_object"), sure.cast("double").alias("confidence")
    )
    c = F.col
    x = lambda entity, **fields: exported(spark, sf_dir, entity, confidence="confidence:double", **fields)
    deps = edges.merge_dependencies(dependencies(spark, sf_dir), [P])
    rels = edges.merge_relationships(relationships(spark, sf_dir), [P])
    owned = owner_rules(spark, sf_dir).withColumn("sure", F.when(c("source") == "codeowners", 0.95).otherwise(0.75))
    parts = [
        row(x("domain", name="name"), "domain-discovery", c("name"), F.lit("is-domain"), F.lit("true"), c("confidence")),
        row(x("entrypoint", file="file", framework="framework"), "entrypoint-discovery", c("file"), F.lit("is-entrypoint"), c("framework"), c("confidence")),
        row(x("architecture", pattern="pattern"), "architecture-inference", c(P), F.lit("architecture"), c("pattern"), c("confidence")),
        row(deps, "dependency-discovery", c("source"), F.lit("depends-on"), F.concat_ws(":", "target", "type"), c("confidence")),
        row(rels, "relationship-discovery", c("source"), c("kind"), c("target"), c("confidence")),
        row(owned, "ownership-discovery", c("pattern"), F.lit("owned-by"), c("owner"), c("sure")),
        row(risks(spark, sf_dir), "risk-discovery", c("target"), F.lit("has-risk"), c("kind"), c("confidence")),
    ]
    every = reduce(DataFrame.unionByName, parts).dropna(subset=[P, "subject", "predicate", "claim_object"])
    sure = numbers.confidence(F.coalesce(F.nanvl(F.max("confidence"), F.lit(0.0)), F.lit(0.0)))
    once = every.groupBy(P, "subject", "predicate", "claim_object").agg(F.min("source_pass").alias("source_pass"), sure.alias("confidence"))
    return once.select(P, ids.claim_id(c("subject"), c("predicate"), c("claim_object")).alias("claim_id"), "subject", "predicate", "claim_object", "source_pass", "confidence")


QUERIES = {
    f.__name__: f
    for f in (
        finding_summary, finding_dedupe, readiness_scores, readiness_scopes, policy_gates, finding_diff, dependency_merge, relationship_merge, fan_in_risk, coupling_risk, risks, top_risks, risk_ranking, bidirectional_edges,
        edge_search, statistics, list_dependencies, find_component, find_dependency, find_relationship, evidence_search, impact, architecture_signals, architecture_scores, confidence_distribution,
        latency_percentiles, set_metrics, token_domains, path_classes, path_names, model_ids, claim_ids, redacted_evidence, duplicate_documents, large_documents, ownership_resolution, unclear_ownership,
        exposure, project_imports, resolved_imports, missing_references, contradictions, claim_lifecycle, claim_evidence, claim_explanations, evidence_links, brain_summary, list_claims, invalidations, contradiction_delta, contract_violations,
        snapshot_registry, trace_dependents, blast_radius, trace_dependencies, trace_confidence, entrypoint_downstream, mutual_dependencies, domain_modules, path_search, find_domain, built_claims,
    )
}
