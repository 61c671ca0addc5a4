"""What keeps agents from files: which agents a repository has, ignore lists and deny lists as rows, and who may still read a path.

Everything is a row of its repository, so any number of repositories with lists of any length are handled in one job (matching.last_rule).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions import paths as P
from strataform.operators import matching
from strataform.operators.skew import join_dimension

#: The supported agents, and the patterns by which one of them leaves environment files out by itself.
AGENTS = ["claude-code", "codex", "cursor"]
CURSOR_DEFAULTS = [".env", ".env.*", "**/.env", "**/.env.*"]

_NAME = {".gitignore": "gitignore", ".cursorignore": "cursorignore"}


def agents(files: DataFrame) -> DataFrame:
    """repo, agent: the agents of which a repository has any trace."""
    p, name = F.col("path"), P.basename(F.col("path"))
    traces = {
        "claude-code": p.startswith(".claude/") | name.isin("CLAUDE.md", "CLAUDE.local.md"),
        "codex": p.startswith(".codex/") | name.isin("AGENTS.md", "AGENTS.override.md"),
        "cursor": p.startswith(".cursor/") | (p == ".cursorrules") | (name == "AGENTS.md") | (p.contains(".cursor/rules/") & name.rlike(r"\.mdc?\z")),
    }
    each = F.filter(F.array(*[F.when(t, F.lit(a)) for a, t in traces.items()]), lambda a: a.isNotNull())
    return files.where("kind = 'file'").select("repo", F.explode(each).alias("agent")).distinct()


def ignore_rules(files: DataFrame) -> DataFrame:
    """repo, list (gitignore, cursorignore, cursor-defaults), ord, pattern, keep (taken back in): the lines of all ignore files.

    The files at the root come first, then the others in path order, whose patterns are rebased to the root.
    """
    name = P.basename(F.col("path"))
    f = files.where((F.col("kind") == "file") & name.isin(*_NAME) & F.col("text").isNotNull())
    kind = F.create_map(*[F.lit(x) for kv in _NAME.items() for x in kv])
    lines = f.select("repo", kind[name].alias("list"), "path", P.dirname(F.col("path")).alias("base"), F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    body = F.regexp_replace(F.trim("raw"), r"\\ ", " ")
    lines = lines.withColumn("body", body).where("body <> '' and not startswith(body, '#')")
    keep = F.col("body").startswith("!")
    bare = F.when(keep, F.substring("body", 2, 1 << 30)).otherwise(F.col("body"))
    rebased = F.when(F.col("base") == "", bare).otherwise(F.concat("base", F.lit("/"), F.regexp_replace(bare, r"\A(?:/|\*\*/)", "")))
    told = lines.select("repo", "list", F.struct((F.col("base") != "").alias("nested"), "path", "line").alias("ord"), rebased.alias("pattern"), keep.alias("keep"))
    some = F.explode(F.array(*[F.struct(F.lit(i).alias("line"), F.lit(p).alias("pattern")) for i, p in enumerate(CURSOR_DEFAULTS)]))
    own = files.select("repo").distinct().select("repo", some.alias("x"))
    own = own.select("repo", F.lit("cursor-defaults").alias("list"), F.struct(F.lit(False).alias("nested"), F.lit("").alias("path"), F.col("x.line").alias("line")).alias("ord"), "x.pattern", F.lit(False).alias("keep"))
    return told.unionByName(own)


def ignored(paths: DataFrame, rules: DataFrame, scope: list[str]) -> DataFrame:
    """scope, path of the paths whose last matching rule (scope, ord, pattern, keep) leaves them out."""
    ready = matching.anchored(rules, F.col("pattern")).withColumn("regex", P.ignore_regex_of(F.col("pattern")))
    return matching.last_rule(paths, ready, scope, "keep").where("not rule").select(*scope, "path")


def denials(files: DataFrame) -> DataFrame:
    """repo, agent, by (path or name), value: what an agent's own settings deny."""
    f = files.where((F.col("kind") == "file") & F.col("text").isNotNull())
    settings = f.where(F.col("path").isin(".claude/settings.json", ".claude/settings.local.json"))
    reads = settings.select("repo", F.explode(F.regexp_extract_all("text", F.lit(r"Read\(([^()\n]*)\)"), F.lit(1))).alias("v"))
    name = F.regexp_extract("v", r"\A/\*\*/([^/]+)\z", 1)
    claude = reads.select(
        "repo", F.lit("claude-code").alias("agent"), F.when(name != "", "name").otherwise("path").alias("by"),
        F.when(name != "", name).otherwise(F.regexp_replace(F.regexp_replace("v", r"\A\./", ""), r"/(?:\*\*)?\z", "")).alias("value"),
    )
    config = f.where("path = '.codex/config.toml'")
    lines = config.select("repo", F.explode(F.split("text", "\n")).alias("l"))
    told = F.coalesce(F.nullif(F.regexp_extract("l", r'^\s*"([^"]+)"\s*=\s*"deny"\s*$', 1), F.lit("")), F.nullif(F.regexp_extract("l", r"^\s*'([^']+)'\s*=\s*'deny'\s*$", 1), F.lit("")))
    codex = lines.select("repo", F.lit("codex").alias("agent"), F.lit("path").alias("by"), F.regexp_replace(told, r"/\*\*\z", "").alias("value"))
    return claude.unionByName(codex).where("value <> ''").distinct()


def denied(paths: DataFrame, files: DataFrame) -> DataFrame:
    """repo, path, agent: the paths that an agent's settings deny it."""
    keys = F.explode(F.array(F.struct(F.lit("path").alias("by"), F.col("path").alias("value")), F.struct(F.lit("name").alias("by"), P.basename(F.col("path")).alias("value"))))
    each = paths.select("repo", "path", keys.alias("k")).select("repo", "path", "k.by", "k.value")
    return each.join(denials(files), ["repo", "by", "value"]).select("repo", "path", "agent").distinct()


def exposed(paths: DataFrame, files: DataFrame, cursor_lists: list[str], present: DataFrame) -> DataFrame:
    """repo, path, agents: the agents of ``present`` (repo, agent) that may read each path, in order; paths that none may read are left out.

    ``cursor_lists``: the ignore lists of which each alone keeps a path from that agent; the other agents go by their deny lists.
    """
    own = paths.select("repo", "path").dropna().distinct()
    pairs = join_dimension(own, present.select("repo", "agent").distinct(), ["repo"], "path")
    rules = ignore_rules(files).where(F.col("list").isin(cursor_lists))
    # Each list decides for itself.
    listed = own.withColumn("list", F.explode(F.array(*[F.lit(x) for x in cursor_lists])))
    out = [ignored(listed, rules, ["repo", "list"]).select("repo", "path", F.lit("cursor").alias("agent")), denied(own, files)]
    left = pairs.join(reduce(DataFrame.unionByName, out).distinct(), ["repo", "path", "agent"], "left_anti")
    return left.groupBy("repo", "path").agg(F.array_sort(F.collect_set("agent")).alias("agents"))


def every_agent(files: DataFrame) -> DataFrame:
    """The agents of a repository, or all that are known where it shows none."""
    some = agents(files)
    rest = files.select("repo").distinct().join(some, "repo", "left_anti")
    return some.unionByName(rest.select("repo", F.explode(F.array(*[F.lit(a) for a in AGENTS])).alias("agent")))


def exposure(paths: DataFrame, rules: DataFrame, scope: list[str]) -> DataFrame:
    """scope, path, agents: of the agents that have rules (scope, agent, ord, pattern, keep) in the scope, those that don't leave the path out."""
    own = paths.select(*scope, "path").dropna().distinct()
    pairs = join_dimension(own, rules.select(*scope, "agent").distinct(), scope, "path")
    left = pairs.join(ignored(pairs, rules, [*scope, "agent"]), [*scope, "agent", "path"], "left_anti")
    told = left.groupBy(*scope, "path").agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    none: Column = F.array().cast("array<string>")
    return own.join(told, [*scope, "path"], "left").withColumn("agents", F.coalesce("agents", none))
