"""Paths against ordered patterns, files against agents, texts against each other, predictions against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions import paths as P
from strataform.functions.text import normal_content
from strataform.operators.skew import join_dimension


def anchored(rules: DataFrame, pattern: Column) -> DataFrame:
    """Adds ``anchor``, what every path that can match the pattern has among its keys: the longest segment without wildcards, else the
    extension the pattern ends with, else nothing."""
    parts = F.filter(F.split(pattern, "/"), lambda p: p != "")
    plain = F.array_max(F.transform(F.filter(parts, lambda p: ~p.rlike(r"[*?]")), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    ext = F.nullif(F.regexp_extract(F.try_element_at(parts, F.lit(-1)), r"\A.*[*?].*\.([^*?.]+)\z", 1), F.lit(""))
    return rules.withColumn("anchor", F.coalesce(F.concat(F.lit("seg:"), plain), F.concat(F.lit("ext:"), ext), F.lit("")))


def _keys(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    names = F.transform(parts, lambda p: F.concat(F.lit("seg:"), p))
    exts = F.transform(F.filter(parts, lambda p: p.contains(".")), lambda p: F.concat(F.lit("ext:"), F.regexp_extract(p, r"\.([^.]*)\z", 1)))
    return F.array_distinct(F.concat(F.array(F.lit("")), names, exts))


def last_rule(paths: DataFrame, rules: DataFrame, scope: list[str], payload: str, path: str = "path") -> DataFrame:
    """scope, path, rule: of every path that some rule of its scope matches, the ``payload`` of the matching rule with the greatest ``ord``.

    ``rules``: scope, anchor (see anchored), regex, ord, payload, any number of them. A path meets only the rules whose anchor it has;
    the rules are sent to the paths if they are small, and lie over salts if not (skew.join_dimension). Null paths take no part.
    """
    each = paths.select(*scope, F.col(path).alias("path")).dropna().distinct().withColumn("anchor", F.explode(_keys(F.col("path"))))
    met = join_dimension(each, rules.select(*scope, "anchor", "regex", "ord", F.col(payload).alias("rule")), [*scope, "anchor"], "path")
    hits = met.where(F.rlike("path", F.col("regex")))
    return hits.groupBy(*scope, "path").agg(F.max_by("rule", "ord").alias("rule"))


def resolve_owners(paths: DataFrame, rules: DataFrame, scope: list[str]) -> DataFrame:
    """scope, path, owner, owner_source (null without an owner). ``rules``: scope, pattern, owner, source (codeowners, package, maintainers).

    An owners file's last matching rule, in the order of its patterns, goes before the longest matching package pattern, and that before
    the maintainers. Of equal patterns the greatest owner counts.
    """
    rank = F.when(F.col("source") == "codeowners", 2).when(F.col("source") == "package", 1).otherwise(0)
    longest = F.when(F.col("source") == "package", F.length("pattern")).otherwise(0)
    ready = anchored(rules.dropna(subset=[*scope, "pattern", "owner"]), F.trim("pattern")).select(
        *scope, "anchor", P.owners_regex_of(F.col("pattern")).alias("regex"), F.struct(rank.alias("rank"), longest.alias("n"), "pattern", "owner").alias("ord"), F.struct("owner", F.col("source").alias("owner_source")).alias("told")
    )
    own = paths.select(*scope, "path").dropna().distinct()
    found = last_rule(own, ready, scope, "told").select(*scope, "path", "rule.owner", "rule.owner_source")
    return own.join(found, [*scope, "path"], "left")


def duplicate_classes(docs: DataFrame, scope: list[str], key: str, text: str, least: int = 80) -> DataFrame:
    """scope, key, class_id, n_copies of every document whose normal content (``least`` characters or more) another document shares.

    class_id is the least key of the class. Documents are grouped by hash of their content: (hash, count, least key) is combined before
    the shuffle, and the classes come back to the documents by the hash, so a class of any size is never gathered.
    """
    forms = docs.select(*scope, key, normal_content(F.col(text)).alias("__n")).where(F.length("__n") >= least)
    hashed = forms.select(*scope, key, F.sha2("__n", 256).alias("__h")).distinct()
    classes = hashed.groupBy(*scope, "__h").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return hashed.join(classes, [*scope, "__h"]).select(*scope, key, "class_id", "n_copies")


def missing_references(references: DataFrame, files: DataFrame, scope: list[str]) -> DataFrame:
    """References (scope, path, ref, and ``tries``, the paths it may mean) of which no try is a file or a directory of the scope."""
    held = files.select(*scope, F.explode(F.array_append(P.ancestors(F.col("path")), F.col("path"))).alias("__try")).distinct().withColumn("__held", F.lit(1))
    tried = references.select(*scope, "path", "ref", F.explode_outer("tries").alias("__try")).join(held, [*scope, "__try"], "left")
    return tried.groupBy(*scope, "path", "ref").agg(F.count("__held").alias("__n")).where("__n = 0").select(*scope, "path", "ref")


def set_metrics(truth: DataFrame, actual: DataFrame, scope: list[str], item: str) -> DataFrame:
    """Per scope: true positives, false positives, false negatives, precision, recall and F1 at four decimals (1 where nothing was asked or told)."""
    from strataform.functions.numbers import js_round

    t = truth.select(*scope, item).dropna().distinct().withColumn("__t", F.lit(1))
    a = actual.select(*scope, item).dropna().distinct().withColumn("__a", F.lit(1))
    counts = t.join(a, [*scope, item], "full").groupBy(*scope).agg(
        F.count_if(F.col("__t").isNotNull() & F.col("__a").isNotNull()).alias("tp"), F.count_if(F.col("__t").isNull()).alias("fp"), F.count_if(F.col("__a").isNull()).alias("fn")
    )
    ratio = lambda x, y: F.when(y == 0, 1.0).otherwise(x / y)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return counts.withColumns({"precision": js_round(p, 4), "recall": js_round(r, 4), "f1": js_round(f1, 4)})
