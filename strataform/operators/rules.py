"""Findings over source trees: one function per rule, from the file table of sources.repofs to rows of one shape."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions import paths, text
from strataform.operators import exclusions, matching, passes
from strataform.operators.skew import broadcast_within
from strataform.sources import servers
from strataform.sources.shared import written

COLUMNS = ["repo", "rule_id", "severity", "path", "detail", "agents"]

#: Instruction files of coding agents.
INSTRUCTIONS = r"(^|/)(CLAUDE(\.local)?|AGENTS(\.override)?)\.md\z|(^|/)\.cursorrules\z|(^|/)\.cursor/rules/.*\.(md|mdc)\z|(^|/)\.claude/rules/.*\.md\z"


def _rows(df: DataFrame, rule: str, severity: Column | str, detail: Column | None = None, agents: Column | None = None) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    none = F.array().cast("array<string>")
    return df.select("repo", F.lit(rule).alias("rule_id"), sev.alias("severity"), "path", (detail if detail is not None else F.lit("")).alias("detail"), (agents if agents is not None else none).alias("agents"))


def instructions(files: DataFrame) -> DataFrame:
    return files.where((F.col("kind") == "file") & F.col("path").rlike(INSTRUCTIONS))


def environment_files(files: DataFrame) -> DataFrame:
    """Environment files that some agent of the repository may read, and all where it has no agents; backups warn, others are critical.
    Samples and templates don't count."""
    f = files.where(F.col("kind") == "file").withColumn("k", paths.env_class(F.col("path"))).where(F.col("k").isin("runtime", "backup") & ~paths.is_sample_path(F.col("path")))
    present = exclusions.agents(files)
    severity = F.when(F.col("k") == "backup", "warning").otherwise("critical")
    seen = f.join(exclusions.exposed(f, files, ["cursorignore", "gitignore", "cursor-defaults"], present), ["repo", "path"])
    alone = f.join(present, "repo", "left_anti")
    told = _rows(seen, "security/env-file-exposure", severity, F.col("k"), F.col("agents"))
    return told.unionByName(_rows(alone, "security/env-file-exposure", severity, F.concat("k", F.lit("-no-agent"))))


def _with_agents(found: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the agents of the repository, in order; none is an empty list."""
    own = exclusions.agents(files).groupBy("repo").agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    return join_left(found, own).withColumn("agents", F.coalesce("agents", F.array().cast("array<string>")))


def join_left(found: DataFrame, own: DataFrame) -> DataFrame:
    # Three agents at most, so a row per repository.
    return found.join(broadcast_within(own), "repo", "left")


def private_keys(files: DataFrame) -> DataFrame:
    label = paths.key_file_class(F.col("path"))
    found = files.where(F.col("kind") == "file").withColumn("k", label).where(F.col("k").isNotNull() & ~paths.is_sample_path(F.col("path")))
    return _rows(_with_agents(found, files), "security/private-key-file", "critical", F.col("k"), F.col("agents"))


def bypassed_permissions(files: DataFrame) -> DataFrame:
    found = files.where(F.col("path").rlike(r"(^|/)\.claude/settings(\.local)?\.json\z") & F.col("text").rlike(r'"defaultMode"\s*:\s*"bypassPermissions"'))
    return _rows(found, "security/claude-bypass-permissions", "warning")


def broad_scopes(files: DataFrame) -> DataFrame:
    each = servers.servers(files).select("repo", "path", "agent", "name", F.explode("scopes").alias("scope"))
    found = each.withColumn("c", servers.scope_class(F.col("scope"), F.col("repo"))).where("c in ('broad', 'outside')")
    return _rows(found, "security/mcp-broad-filesystem", "critical", F.concat_ws(" ", "name", "scope", "c"), F.array("agent"))


def malformed_configs(files: DataFrame) -> DataFrame:
    found = servers.servers(files).where("parse_error is not null").groupBy("repo", "path", "agent").agg(F.min("parse_error").alias("e"))
    return _rows(found, "mcp/malformed-config", "warning", F.col("e"), F.array("agent"))


def twice_named_servers(files: DataFrame) -> DataFrame:
    return _rows(servers.duplicate_servers(servers.servers(files)), "mcp/duplicate-server", "info", F.col("name"), F.array("agent"))


def large_instructions(files: DataFrame) -> DataFrame:
    found = instructions(files).withColumn("s", paths.size_class(F.col("size_bytes"))).where("s is not null")
    return _rows(found, "context/large-instruction-file", F.col("s"))


def _unlisted(found: DataFrame, files: DataFrame) -> DataFrame:
    """Without the paths that the ignore files of version control leave out; a directory is judged with a slash behind it too."""
    git = exclusions.ignore_rules(files).where("list = 'gitignore'")
    tries = found.select("repo", "path", F.explode(F.when(F.col("kind") == "skipped", F.array("path", F.concat("path", F.lit("/")))).otherwise(F.array("path"))).alias("try"))
    out = exclusions.ignored(tries.select("repo", F.col("try").alias("path")), git, ["repo"]).withColumn("path", F.regexp_replace("path", r"/\z", "")).distinct()
    return found.join(out, ["repo", "path"], "left_anti")


def large_logs(files: DataFrame, least: int = 256 << 10) -> DataFrame:
    """Logs and dumps of ``least`` bytes or more that neither version control nor some agent leaves out; without agents all are asked."""
    found = _unlisted(files.where((F.col("kind") == "file") & paths.is_log_like(F.col("path")) & (F.col("size_bytes") >= least)), files)
    seen = found.join(exclusions.exposed(found, files, ["cursorignore"], exclusions.every_agent(files)), ["repo", "path"])
    return _rows(seen, "context/large-log-file", "info", F.concat(F.col("size_bytes").cast("string"), F.lit(" bytes")), F.col("agents"))


#: Directories of build output; vendor is one outside PHP projects only.
GENERATED = ["dist", "build", "coverage", ".next", ".nuxt", ".svelte-kit", ".dart_tool", "target"]


def generated_directories(files: DataFrame) -> DataFrame:
    """Pruned directories of build output that some agent of the repository may read, unless samples, ignored, checked-in actions, or
    source packages that only have such a name. A repository without agents has none."""
    name = paths.basename(F.col("path"))
    parents = F.transform(F.split(paths.dirname(F.col("path")), "/"), F.lower)
    source_like = F.lower(name).isin("build", "target", "vendor") & F.arrays_overlap(parents, F.array(*[F.lit(x) for x in "bin cmd internal lib pkg script scripts src".split()]))
    action = F.col("path").rlike(r"(?i)\A\.github/actions/[^/]+/dist\z")
    php = passes.package_managers(files).where("manager = 'composer'").select("repo").unionByName(passes.primary_language(files).where("language = 'php'").select("repo")).distinct()
    pruned = files.where((F.col("kind") == "skipped") & ~source_like & ~paths.is_sample_path(F.col("path")))
    vendor = pruned.where(name == "vendor").join(php, "repo", "left_anti")
    found = _unlisted(pruned.where(name.isin(GENERATED) & ~action).unionByName(vendor), files)
    both = found.withColumn("own", F.col("path")).withColumn("path", F.explode(F.array("path", F.concat("path", F.lit("/")))))
    # Left out by either way of writing the directory.
    seen = exclusions.exposed(both, files, ["cursorignore"], exclusions.agents(files)).withColumn("path", F.regexp_replace("path", r"/\z", ""))
    each = seen.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("agents")).alias("l"))
    agents = F.array_sort(F.array_distinct(F.filter("l", lambda a: F.size(F.filter("l", lambda b: a == b)) == 2)))
    told = found.join(each.select("repo", "path", agents.alias("agents")).where(F.size("agents") > 0), ["repo", "path"])
    return _rows(told, "context/generated-directory", "info", None, F.col("agents"))


def empty_instructions(files: DataFrame) -> DataFrame:
    return _rows(instructions(files).where("is_empty"), "instructions/empty-instructions", "warning")


def duplicate_instructions(files: DataFrame) -> DataFrame:
    """Later instruction files with the body of an earlier one (in path order)."""
    classes = matching.duplicate_classes(instructions(files), ["repo"], "path", "text").where("path <> class_id")
    return _rows(classes, "instructions/duplicate-content", "info", F.concat(F.lit("duplicate_of="), F.col("class_id")))


def missing_paths(files: DataFrame) -> DataFrame:
    """References of instruction files to paths that are not there, or that lead out of the repository."""
    own = instructions(files).where("text is not null")
    refs = own.select("repo", "path", F.explode(text.local_references(F.col("text"))).alias("ref")).distinct()
    return _rows(matching.missing_references(text.reference_tries(refs), files.select("repo", "path"), ["repo"]), "instructions/missing-path-reference", "warning", F.col("ref"))


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "security/env-file-exposure": environment_files,
    "security/private-key-file": private_keys,
    "security/claude-bypass-permissions": bypassed_permissions,
    "security/mcp-broad-filesystem": broad_scopes,
    "mcp/malformed-config": malformed_configs,
    "mcp/duplicate-server": twice_named_servers,
    "context/large-instruction-file": large_instructions,
    "context/large-log-file": large_logs,
    "context/generated-directory": generated_directories,
    "instructions/empty-instructions": empty_instructions,
    "instructions/duplicate-content": duplicate_instructions,
    "instructions/missing-path-reference": missing_paths,
}


def run(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The findings of all rules; an include list goes before an exclude list. Agents, ignore and deny lists are those of each repository.

    The tree is read once and written to the shared folder, of which every rule reads the columns it needs.
    """
    files = written(files)
    parts = [f(files) for r, f in RULES.items() if (r in include if include else r not in (exclude or []))]
    return reduce(DataFrame.unionByName, parts) if parts else _rows(files.limit(0), "", "info")
