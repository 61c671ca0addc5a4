"""Reports over the model: heads of lists, summaries by kind, roll-ups, links of components, and documents as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions import numbers, paths
from strataform.functions.clean import norm_key, strip
from strataform.functions.text import printable
from strataform.operators import nested
from strataform.plans import reference as R
from strataform.sources.tables import table

P = R.P
#: Rows of a section and of a step summary.
SECTION, STEP = 8, 20


def finding_heads(spark: SparkSession, sf_dir: str, most: int = SECTION) -> DataFrame:
    """The first findings of each repository: by severity, the gravest first, then by id."""
    f = R.event_findings(spark, sf_dir)
    order = Window.partitionBy("repo").orderBy(numbers.rank_of(F.col("severity"), numbers.SEVERITIES).desc(), "finding_id")
    return f.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("repo", "place", "finding_id", "severity", "rule_id")


def risk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project and kind the number of risks."""
    return R.risks(spark, sf_dir).groupBy(P, "kind").agg(F.count(F.lit(1)).alias("n"))


def pass_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pass over all stored claims: claims, projects, mean and least confidence, and how many stand."""
    c = R.latest_claims(spark, sf_dir, source_pass=norm_key("source_pass"), status=R.norm_upper("status"), confidence=F.col("confidence")).where("source_pass is not null")
    return c.groupBy("source_pass").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_distinct(P).alias("n_projects"), numbers.mean_confidence(F.col("confidence")).alias("confidence"), F.min("confidence").alias("least"), F.count_if(F.col("status") == "ACTIVE").alias("n_active"),
    )


#: Patterns that are asked for; others that are inferred often are noise.
REQUIRED = ["MVC", "Clean Architecture", "Modular Monolith"]


def noise_leaders(spark: SparkSession, sf_dir: str, most: int = 5) -> DataFrame:
    """The patterns that nobody asked for and that most projects are told to have."""
    found = R.architecture_scores(spark, sf_dir).where(~F.col("pattern").isin(REQUIRED))
    # At most one row per pattern, and the patterns are fixed.
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(most)


def component_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exported component with what is tied to it in its project: edges in and out by its name, entrypoints at its path, the last
    domain in whose directory it lies, its owner by the rules, and its kind: entrypoint before domain before module."""
    parts = R.exported(spark, sf_dir, "component", id="id", name="name", path="path").dropna(subset=[P, "path"]).select(P, "id", strip("name").alias("name"), "path").where("path <> ''").distinct()
    d = R.dependencies(spark, sf_dir)
    count = lambda end, out: d.groupBy(P, F.col(end).alias("key")).agg(F.count(F.lit(1)).alias(out))
    entries = R.exported(spark, sf_dir, "entrypoint", file="file").dropna(subset=[P, "file"]).groupBy(P, F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("n_entries"))
    exports = table(spark, sf_dir, "brain_exports")
    of = exports.select("export_id", norm_key(P).alias(P)).dropna()
    items = nested.flat_items(exports, "export_id").where("entity = 'domain_path'").select("export_id", F.col("parent_pos").alias("pos"), paths.dirname(F.col("item")).alias("dir")).where("dir <> ''")
    domains = R.exported(spark, sf_dir, "domain", domain="name").drop(P).join(items, ["export_id", "pos"]).join(of, "export_id").groupBy(P, "dir").agg(F.max("domain").alias("domain"))
    inside = parts.select(P, "path").distinct().withColumn("dir", F.explode(paths.ancestors(F.col("path")))).join(domains, [P, "dir"]).groupBy(P, "path").agg(F.max("domain").alias("domain"))
    owners = R.matching.resolve_owners(parts, R.owner_rules(spark, sf_dir), [P]).select(P, "path", "owner")
    out = parts.withColumn("key", norm_key("name")).join(count("target", "n_in"), [P, "key"], "left").join(count("source", "n_out"), [P, "key"], "left")
    out = out.join(entries, [P, "path"], "left").join(inside, [P, "path"], "left").join(owners, [P, "path"], "left").na.fill(0, ["n_in", "n_out", "n_entries"])
    kind = F.when(F.col("n_entries") > 0, "entrypoint").when(F.col("domain").isNotNull(), "domain").otherwise("module")
    return out.select(P, "id", "name", "path", "n_in", "n_out", "n_entries", "domain", "owner", kind.alias("kind"))


def domain_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored evidence whose locator is one of a domain's paths: project_id, domain, locator, n_evidence (distinct ids)."""
    exports = table(spark, sf_dir, "brain_exports")
    items = nested.flat_items(exports, "export_id").where("entity = 'domain_path'").select("export_id", F.col("parent_pos").alias("pos"), F.col("item").alias("locator"))
    told = R.exported(spark, sf_dir, "domain", domain="name").join(items, ["export_id", "pos"]).select(P, "domain", "locator").dropna().distinct()
    held = table(spark, sf_dir, "brain_evidence").select(norm_key(P).alias(P), norm_key("evidence_id").alias("evidence_id"), "locator").dropna().distinct()
    return told.join(held, [P, "locator"]).groupBy(P, "domain", "locator").agg(F.count(F.lit(1)).alias("n_evidence"))


def unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nothing is known of, per project with any rows: owners, domains, entrypoints, architectures."""
    every = R.dependencies(spark, sf_dir).select(P).unionByName(R.locators(spark, sf_dir).select(P)).distinct()
    some = {
        "no owner rules": R.owner_rules(spark, sf_dir),
        "no domains": R.exported(spark, sf_dir, "domain", name="name"),
        "no entrypoints": R.exported(spark, sf_dir, "entrypoint", file="file"),
        "no architectures": R.exported(spark, sf_dir, "architecture", pattern="pattern"),
    }
    parts = [every.join(df.select(P).dropna().distinct(), P, "left_anti").withColumn("unknown", F.lit(what)) for what, df in some.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def step_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository the counts by severity and its first findings, gravest first, as one text."""
    heads = finding_heads(spark, sf_dir, STEP)
    told = heads.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(" ", "severity", "rule_id", "finding_id").alias("l")))).alias("l"))
    counts = R.finding_summary(spark, sf_dir)
    return counts.join(told, "repo").select("repo", "n_critical", "n_warning", "n_info", F.array_join(F.transform("l", lambda x: x["l"]), "\n").alias("findings"))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository its summary and score as one JSON text with the fields in a fixed order, without control characters."""
    f = R.event_findings(spark, sf_dir)
    both = R.findings.summarize(f, ["repo"]).join(R.findings.scores(f, ["repo"]), "repo")
    body = F.to_json(F.struct("repo", "score", F.struct(F.col("n_critical").alias("critical"), F.col("n_warning").alias("warning"), F.col("n_info").alias("info"), F.col("n_total").alias("total")).alias("summary")))
    return both.select("repo", printable(body).alias("report"))


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository the findings that are new, resolved and remaining against the baseline."""
    f = R.event_findings(spark, sf_dir).withColumn("id", F.struct("repo", "path"))
    late = F.col("ts") >= F.lit(R.BASELINE).cast("timestamp")
    seen = R.findings.compare(f.where(~late), f.where(late), "id")
    return seen.groupBy(F.col("id.repo").alias("repo")).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "resolved", "remaining")])


QUERIES = {f.__name__: f for f in (finding_heads, risk_kinds, pass_rollup, noise_leaders, component_links, domain_evidence, unknowns, step_summary, report_json, verify_report)}
