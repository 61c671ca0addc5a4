"""Queries over trees: rules, owners, agents, servers, project marks, dependencies and relationships, over a file table.

The tables hold no source trees, so ``tree`` builds one per project from what they tell: every component of an edge is a source file whose
text imports what its edges name, package edges are manifests, evidence gives environment and key files, pruned directories and ignore
lists, notes give instruction and owners files and logs, and claims of entrypoints give the servers of a configuration. A job over real
trees takes the rows of ``sources.repofs`` instead; the operators are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions import paths
from strataform.functions.clean import norm_key, norm_upper, strip
from strataform.operators import exclusions, passes, rules
from strataform.plans import reference as R
from strataform.sources import servers
from strataform.sources.shared import written
from strataform.sources.tables import table

FILE = ["repo", "path", "kind", "size_bytes", "is_symlink", "is_binary", "is_empty", "text"]
#: How much larger logs and instruction files are taken to be than the notes they are made of.
LOG_SCALE, INSTRUCTION_SCALE = 256, 16
#: Names that stand in for configuration keys, and directories that stand in for ownership rules, by the length of the locator.
SECRET_NAMES = [".env", ".env.local", ".env_backup", ".env.example", "id_rsa", "server.pem", "public-cert.pem", "credentials.json", "app.key", "settings.json"]
PRUNED_NAMES = ["dist", "build", "coverage", ".next", "node_modules", "vendor", "target", "out"]


def _file(df: DataFrame, path: Column, text: Column | None = None, kind: str = "file", size: Column | None = None) -> DataFrame:
    text = F.lit(None).cast("string") if text is None else text
    size = F.octet_length(text).cast("long") if size is None else size
    empty = ~text.rlike(r"\S")
    return df.select("repo", path.alias("path"), F.lit(kind).alias("kind"), size.alias("size_bytes"), F.lit(False).alias("is_symlink"), F.lit(False).alias("is_binary"), empty.alias("is_empty"), text.alias("text"))


def source_path(name: Column) -> Column:
    """OrderTaskService is src/order/task.service.ts."""
    dotted = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1.$2"))
    return F.concat(F.lit("src/"), F.regexp_replace(dotted, r"\A([^.]+)\.", "$1/"), F.lit(".ts"))


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, source, target, type: the dependencies by their names as spelt, repeats too; files and manifests take each once."""
    t = table(spark, sf_dir, "dependency_matches")
    t = t.select(norm_key("project_id").alias("repo"), strip("dep_from").alias("source"), strip("dep_to").alias("target"), norm_key("dep_type").alias("type"))
    return t.where("source <> '' and target <> ''").dropna()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tree_edges(spark, sf_dir).where("type <> 'package'")
    deep = source_path(F.col("source")).rlike(r"\Asrc/[^/]+/")
    to = F.concat(F.when(deep, "../").otherwise("./"), F.regexp_replace(F.regexp_replace(source_path(F.col("target")), r"\Asrc/", ""), r"\.ts\z", ""))
    line = (
        F.when(F.col("type") == "require", F.concat(F.lit("const x = require('"), to, F.lit("');")))
        .when(F.col("type") == "dynamic-import", F.concat(F.lit("import('"), to, F.lit("');")))
        .when(F.col("type") == "export", F.concat(F.lit("export { X } from '"), to, F.lit("';")))
        .otherwise(F.concat(F.lit("import { X } from '"), to, F.lit("';")))
    )
    r = table(spark, sf_dir, "relationship_matches").where(norm_upper("relationship") == "IMPLEMENTS")
    r = r.select(norm_key("project_id").alias("repo"), strip("rel_source").alias("source"), strip("rel_target").alias("target")).where("source <> '' and target <> ''").dropna()
    head = lambda c: F.concat(F.lit("export class "), F.col(c), F.lit(" {}"))
    lines = [
        edges.select("repo", F.col("source").alias("name"), line.alias("line")),
        *[df.select("repo", F.col(c).alias("name"), head(c).alias("line")) for df in (edges, r) for c in ("source", "target")],
        r.select("repo", F.col("source").alias("name"), F.concat(F.lit("class "), F.col("source"), F.lit(" implements "), F.col("target"), F.lit(" {}")).alias("line")),
    ]
    each = reduce(DataFrame.unionByName, lines).select("repo", source_path(F.col("name")).alias("path"), "line")
    # Heads first: an import never sorts before them.
    text = F.array_join(F.sort_array(F.collect_set(F.concat(F.when(F.col("line").startswith("export class"), "0").otherwise("1"), F.col("line")))), "\n")
    made = each.groupBy("repo", "path").agg(F.regexp_replace(text, r"(?m)^[01]", "").alias("t"))
    return _file(made, F.col("path"), F.col("t"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tree_edges(spark, sf_dir).where("type = 'package'").select("repo", F.lower("source").alias("name"), F.lower("target").alias("to"))
    every = edges.unionByName(edges.select("repo", F.col("to").alias("name"), F.lit(None).cast("string").alias("to")))
    needs = every.groupBy("repo", "name").agg(F.map_from_arrays(F.array_sort(F.collect_set("to")), F.transform(F.array_sort(F.collect_set("to")), lambda _: F.lit("*"))).alias("dependencies"))
    return _file(needs, F.concat(F.lit("packages/"), "name", F.lit("/package.json")), F.to_json(F.struct("name", "dependencies")))


def _evidence(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    t = table(spark, sf_dir, "brain_evidence").where(norm_key("kind") == kind)
    return t.select(norm_key("project_id").alias("repo"), "locator").where("locator <> ''").dropna().distinct().withColumn("n", F.octet_length("locator"))


def _below(name: Column) -> Column:
    folder = paths.dirname(F.col("locator"))
    return F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))


def _pick(names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("n") % len(names)) + 1)


def _notes(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(norm_key("source") == source)
    d = d.select(norm_key("project_id").alias("repo"), "doc_id", F.coalesce("text", F.lit("")).alias("t")).dropna()
    return d.groupBy("repo", "doc_id").agg(F.max("t").alias("t"))


def server_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, name, scope: the framework of an entrypoint claim is a server, its file a path the server may read."""
    c = table(spark, sf_dir, "brain_claims").where(norm_key("predicate") == "is-entrypoint")
    c = c.select(norm_key("project_id").alias("repo"), strip("claim_object").alias("name"), strip("subject").alias("file")).where("name <> '' and file <> ''").dropna().distinct()
    n = F.octet_length("file") % 4
    return c.select("repo", "name", F.when(n == 0, F.concat(F.lit("~/"), "file")).when(n == 1, F.concat(F.lit("../"), "file")).when(n == 2, F.concat(F.lit("/elsewhere/"), "file")).otherwise(F.concat(F.lit("./"), "file")).alias("scope"))


def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = server_args(spark, sf_dir).groupBy("repo", "name").agg(F.array_sort(F.collect_set("scope")).alias("scopes"))
    entry = F.struct(F.lit("npx").alias("command"), F.concat(F.array(F.lit("-y"), F.lit("server-filesystem")), F.col("scopes")).alias("args"))
    maps = args.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name"), entry)))).alias("m"))
    return _file(maps, F.lit(".cursor/mcp.json"), F.to_json(F.struct(F.col("m").alias("mcpServers"))))


def lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Ignore files and settings from the same patterns as the exposure query's."""
    p = R.agent_patterns(spark, sf_dir).withColumnRenamed("project_id", "repo")
    line = F.concat(F.when(F.col("keep"), "!").otherwise(""), F.col("pattern"))
    of = lambda agent, made: p.where(F.col("agent") == agent).groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", made.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    deny = F.concat(F.lit('"Read(./'), F.regexp_replace("ord", '"', ""), F.lit(')",'))
    return [_file(of("cursor", line), F.lit(".cursorignore"), F.col("t")), _file(of("codex", line), F.lit(".gitignore"), F.col("t")), _file(of("claude-code", deny), F.lit(".claude/settings.json"), F.col("t"))]


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file table, one row per repository and path, written once."""
    keys, dirs = _evidence(spark, sf_dir, "config-key"), _evidence(spark, sf_dir, "ownership-rule")
    rules_, logs = _notes(spark, sf_dir, "agent_rules"), _notes(spark, sf_dir, "scan_log")
    named = F.concat(F.lit("note-"), F.col("doc_id").cast("string"))
    t = F.col("t")
    size = lambda scale: F.octet_length("t").cast("long") * scale
    owners = R.owner_rules(spark, sf_dir).where("source = 'codeowners'").groupBy(F.col("project_id").alias("repo")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("  ", "pattern", "owner"))), "\n").alias("t"))
    plain = R.locators(spark, sf_dir).select(F.col("project_id").alias("repo"), F.col("path").alias("p"))
    parts = [
        sources(spark, sf_dir), manifests(spark, sf_dir),
        _file(keys, _below(_pick(SECRET_NAMES)), F.lit("x")), _file(dirs, _below(_pick(PRUNED_NAMES)), kind="skipped"),
        _file(rules_, F.concat(F.lit(".claude/rules/"), named, F.lit(".md")), t, size=size(INSTRUCTION_SCALE)), _file(logs, F.concat(F.lit("logs/"), named, F.lit(".log")), t, size=size(LOG_SCALE)),
        _file(owners, F.lit("CODEOWNERS"), t), configurations(spark, sf_dir), *lists(spark, sf_dir), _file(plain, F.col("p")),
    ]
    rows = reduce(DataFrame.unionByName, parts).groupBy("repo", "path", "kind").agg(F.max(F.struct(*[c for c in FILE if c not in ("repo", "path", "kind")])).alias("r"))
    return written(rows.select("repo", "path", "kind", "r.*"))


def _findings(*names: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rules.run(tree(spark, sf_dir), include=list(names))
        return found.select("repo", "rule_id", "severity", "path", "detail", F.array_join("agents", "|").alias("agents"))

    query.__doc__ = f"Findings of {', '.join(names)} over the trees."
    return query


def tree_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agents of which each repository has traces."""
    return exclusions.agents(tree(spark, sf_dir))


def tree_owner_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner rules that the trees' files state."""
    found = passes.owner_rules(tree(spark, sf_dir))
    return found.select("repo", "path", "ord", "pattern", F.array_join("owners", "|").alias("owners"), "source", "confidence")


def tree_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured tool servers with the class of each path they may read."""
    each = servers.servers(tree(spark, sf_dir)).select("repo", "agent", "name", "transport", F.explode("scopes").alias("scope"))
    return each.withColumn("scope_class", servers.scope_class(F.col("scope"), F.lit("/repo")))


def tree_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each repository by score."""
    return passes.languages(tree(spark, sf_dir))


def tree_managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.package_managers(tree(spark, sf_dir)).select("repo", "manager", "at_root")


def tree_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies between modules and packages, read off the text of the trees."""
    return passes.dependencies(tree(spark, sf_dir)).select("repo", "source", "target", "type", "confidence", F.size("evidence").cast("long").alias("n_evidence"), F.element_at("evidence", 1).alias("first_evidence"))


def tree_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between components, features, domains and packages of the trees."""
    found = passes.relationships(tree(spark, sf_dir))
    return found.select("repo", "source", "target", "kind", "confidence", "strength", "bidirectional", F.size("evidence").cast("long").alias("n_evidence"))


QUERIES = {
    f.__name__: f for f in (tree_agents, tree_owner_rules, tree_servers, tree_languages, tree_managers, tree_dependencies, tree_relationships)
} | {
    "rule_env_files": _findings("security/env-file-exposure"),
    "rule_private_keys": _findings("security/private-key-file"),
    "rule_generated_directories": _findings("context/generated-directory"),
    "rule_large_logs": _findings("context/large-log-file"),
    "rule_large_instructions": _findings("context/large-instruction-file"),
    "rule_empty_instructions": _findings("instructions/empty-instructions"),
    "rule_duplicate_instructions": _findings("instructions/duplicate-content"),
    "rule_missing_paths": _findings("instructions/missing-path-reference"),
    "rule_broad_servers": _findings("security/mcp-broad-filesystem"),
}
