"""Passes over a file table (repo, path, kind, text ...): owners, project marks, dependencies, relationships, fix plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions import numbers as N
from strataform.functions import paths as P
from strataform.functions import text as X
from strataform.operators import entrypoints
from strataform.operators.edges import mark_bidirectional, merge_dependencies, merge_relationships
from strataform.operators.resolve import LOOSE, resolve
from strataform.operators.skew import is_within, join_dimension, join_hot
from strataform.sources.shared import written

# Owners

#: Where owners are told, and how sure each source is.
OWNER_FILES = ["CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS", ".gitlab/CODEOWNERS"]
MAINTAINER_FILES = ["MAINTAINERS", "OWNERS", "docs/MAINTAINERS"]
OWNER_CONFIDENCE = {"codeowners": 0.95, "maintainers-file": 0.85, "package-maintainers": 0.75}


def owner_rules(files: DataFrame) -> DataFrame:
    """repo, path (of the source), ord, pattern, owners, source, confidence: every rule that owners files, maintainers and manifests state."""
    f = files.where((F.col("kind") == "file") & F.col("text").isNotNull())
    lines = f.where(F.col("path").isin(*OWNER_FILES, *MAINTAINER_FILES)).select("repo", "path", F.posexplode(F.split("text", r"\r?\n")).alias("ord", "raw"))
    lines = lines.withColumn("line", F.trim("raw")).where("line <> '' and not startswith(line, '#')")
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    names = F.filter(words, lambda w, i: (i > 0) & ~w.startswith("#"))
    stated = lines.where(F.col("path").isin(*OWNER_FILES)).select("repo", "path", "ord", words[0].alias("pattern"), names.alias("owners"), F.lit("codeowners").alias("source"))
    people = lines.where(F.col("path").isin(*MAINTAINER_FILES)).groupBy("repo", "path").agg(
        F.sort_array(F.collect_list(F.struct("ord", F.regexp_replace("line", r",\s*\z", "").alias("o")))).alias("l")
    )
    people = people.select("repo", "path", F.lit(0).alias("ord"), F.lit("*").alias("pattern"), F.transform("l", lambda x: x["o"]).alias("owners"), F.lit("maintainers-file").alias("source"))
    manifest = f.where(P.basename(F.col("path")) == "package.json").withColumn("v", F.try_parse_json("text"))
    get = lambda v, p: F.trim(F.try_variant_get(v, p, "string"))

    def person(v: Column) -> Column:
        name, mail = get(v, "$.name"), get(v, "$.email")
        told = F.when(F.nullif(name, F.lit("")).isNotNull() & F.nullif(mail, F.lit("")).isNotNull(), F.concat(name, F.lit(" <"), mail, F.lit(">"))).otherwise(
            F.coalesce(F.nullif(name, F.lit("")), F.nullif(mail, F.lit("")))
        )
        is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
        return F.when(is_object, told).otherwise(F.nullif(get(v, "$"), F.lit("")))

    some = F.concat(F.array(person(F.try_variant_get("v", "$.author", "variant"))), F.transform(F.coalesce(F.try_variant_get("v", "$.maintainers", "array<variant>"), F.array().cast("array<variant>")), person))
    folder = P.dirname(F.col("path"))
    packages = manifest.select(
        "repo", "path", F.lit(0).alias("ord"), F.when(folder == "", "*").otherwise(F.concat(folder, F.lit("/**"))).alias("pattern"),
        F.array_distinct(F.filter(some, lambda o: o.isNotNull())).alias("owners"), F.lit("package-maintainers").alias("source"),
    )
    rules = stated.unionByName(people).unionByName(packages).where(F.size("owners") > 0)
    sure = F.create_map(*[F.lit(x) for kv in OWNER_CONFIDENCE.items() for x in kv])
    return rules.withColumn("confidence", sure[F.col("source")])


# Marks of a project

#: Marker files and extensions of languages.
LANGUAGES = {
    "typescript": (["tsconfig.json"], ["ts", "tsx", "mts", "cts"]),
    "javascript": (["jsconfig.json", "package.json"], ["js", "jsx", "mjs", "cjs"]),
    "python": (["pyproject.toml", "requirements.txt", "setup.py", "pipfile"], ["py"]),
    "dart": (["pubspec.yaml"], ["dart"]),
    "php": (["composer.json"], ["php"]),
    "go": (["go.mod", "go.work"], ["go"]),
    "rust": (["cargo.toml"], ["rs"]),
    "java": (["pom.xml", "build.gradle", "build.gradle.kts"], ["java"]),
    "kotlin": (["build.gradle.kts"], ["kt", "kts"]),
}
#: Lock files and markers of package managers, most telling first.
MANAGERS = {
    "pnpm": ["pnpm-lock.yaml", "pnpm-workspace.yaml"],
    "yarn": ["yarn.lock"],
    "bun": ["bun.lockb", "bun.lock"],
    "npm": ["package-lock.json", "npm-shrinkwrap.json", "package.json"],
    "composer": ["composer.lock", "composer.json"],
    "pub": ["pubspec.lock", "pubspec.yaml"],
    "poetry": ["poetry.lock"],
    "cargo": ["cargo.lock", "cargo.toml"],
    "gradle": ["build.gradle", "build.gradle.kts"],
    "pip": ["requirements.txt", "setup.py"],
}
#: Manifests of a project that can be built on its own.
MANIFESTS = "package.json pubspec.yaml composer.json pyproject.toml go.mod cargo.toml pom.xml build.gradle build.gradle.kts".split()


def languages(files: DataFrame) -> DataFrame:
    """repo, language, score: ten for each marker name present, one for each file of an extension; with a marked TypeScript, JavaScript has at most five."""
    name, ext = F.lower(P.basename(F.col("path"))), P.extension(F.col("path"))
    marks = [F.count_distinct(F.when(name.isin(m), name)).alias(f"m_{k}") for k, (m, _) in LANGUAGES.items()]
    sizes = [F.count_if(ext.isin(e)).alias(f"e_{k}") for k, (_, e) in LANGUAGES.items()]
    counts = files.where("kind = 'file'").groupBy("repo").agg(*marks, *sizes)
    score = {k: F.col(f"m_{k}") * 10 + F.col(f"e_{k}") for k in LANGUAGES}
    score["javascript"] = F.when((score["typescript"] >= 10) & (score["javascript"] > 0), F.least(score["javascript"], F.lit(5))).otherwise(score["javascript"])
    each = F.array(*[F.struct(F.lit(k).alias("language"), c.cast("long").alias("score")) for k, c in score.items()])
    return counts.select("repo", F.inline(each)).where("score > 0")


def primary_language(files: DataFrame) -> DataFrame:
    """repo, language: the one with the greatest score, of several the first in the order of the list."""
    place = F.array_position(F.array(*[F.lit(k) for k in LANGUAGES]), F.col("language"))
    return languages(files).groupBy("repo").agg(F.max_by("language", F.struct("score", -place)).alias("language"))


def package_managers(files: DataFrame) -> DataFrame:
    """repo, manager, at_root, place: the managers whose files are there, the most telling first."""
    name = F.lower(P.basename(F.col("path")))
    counts = files.where("kind = 'file'").groupBy("repo").agg(
        *[F.count_if(name.isin(m)).alias(f"n_{k}") for k, m in MANAGERS.items()], *[F.count_if(name.isin(m) & P.is_root_level(F.col("path"))).alias(f"r_{k}") for k, m in MANAGERS.items()]
    )
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("manager"), (F.col(f"n_{k}") > 0).alias("there"), (F.col(f"r_{k}") > 0).alias("at_root")) for i, k in enumerate(MANAGERS)])
    return counts.select("repo", F.inline(each)).where("there").select("repo", "manager", "at_root", "place")


def monorepo(files: DataFrame) -> DataFrame:
    """repo, kind_of_monorepo: by tool configuration, workspaces of the root manifest, or two or more manifests at the root and one level below."""
    f = files.where("kind = 'file'")
    name, parts = F.lower(P.basename(F.col("path"))), F.split("path", "/")
    spaces = F.try_variant_get(F.try_parse_json("text"), "$.workspaces", "variant")
    told = F.coalesce(F.try_variant_get(spaces, "$", "array<variant>"), F.try_variant_get(spaces, "$.packages", "array<variant>")).isNotNull()
    root = F.when(name.isin(MANIFESTS) & (F.size(parts) <= 2), F.when(F.size(parts) == 1, ".").otherwise(parts[0]))
    seen = f.groupBy("repo").agg(
        F.count_if(name.isin("turbo.json", "turbo.jsonc")).alias("turbo"), F.count_if(name == "nx.json").alias("nx"), F.count_if(name == "pnpm-workspace.yaml").alias("pnpm"),
        F.count_if((F.col("path") == "package.json") & told).alias("npm"), F.count_distinct(root).alias("roots"),
    )
    kind = F.when(F.col("turbo") > 0, "turborepo").when(F.col("nx") > 0, "nx").when(F.col("pnpm") > 0, "pnpm-workspaces").when(F.col("npm") > 0, "npm-workspaces").when(F.col("roots") >= 2, "multi-project")
    return seen.select("repo", F.coalesce(kind, F.lit("none")).alias("kind_of_monorepo"))


# Dependencies

#: Segments that name no module.
NO_LABEL = (
    "src lib libs app apps packages package services service modules module internal cmd bin dist build out public static assets test tests spec specs"
    " __tests__ fixtures node_modules vendor main java kotlin resources"
).split()


def module_label(path: Column) -> Column:
    """The last directory that names something, in title case; without one the file's stem."""
    parts = F.split(path, "/")
    dirs = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda d: ~F.lower(d).isin(NO_LABEL) & ~d.contains(".") & d.rlike(r"\A[a-zA-Z][A-Za-z0-9_-]*\z"))
    return P.title_case(F.coalesce(F.try_element_at(dirs, F.lit(-1)), P.stem(F.element_at(parts, -1))))


def relation_type(source: Column, target: Column, base: Column) -> Column:
    """An import told apart by the paths of both ends: route, service, repository or import; other relations stay what they are."""
    s, t = F.lower(source), F.lower(target)
    return (
        F.when(base != "import", base)
        .when(s.rlike(r"(^|/)(routes?|pages?)/"), "route")
        .when(s.contains("controller") & t.contains("service"), "service")
        .when(t.contains("repositor"), "repository")
        .when(t.contains("service") & s.rlike("controller|handler|route"), "service")
        .otherwise("import")
    )


#: What a file does to another by the type of the relation.
VERBS = {"require": "requires", "dynamic-import": "dynamically imports", "export": "re-exports", "route": "routes to", "module": "modules"}


#: Files of one directory, at any depth, above which they are spread over several tasks.
HOT_FILES = 100_000


def labels(files: DataFrame) -> DataFrame:
    """repo, path, label of every file, as an import may mean one that is no source: the package whose directory holds it, the deepest of several, else its module."""
    own = files.where("kind = 'file'").select("repo", "path")
    roots = packages(files).where("root <> ''").select("repo", "root", "name")
    above, on = own.withColumn("root", F.explode(P.ancestors(F.col("path")))), ["repo", "root"]
    if is_within(roots):
        inside = above.join(F.broadcast(roots), on)
    else:
        # Only directories that hold very many files are spread: repeating every root over salts would write each of them 32 times.
        inside = join_hot(above, roots, on, above.groupBy(*on).count().where(F.col("count") > HOT_FILES).drop("count"), "path")
    deepest = inside.groupBy("repo", "path").agg(F.max_by("name", F.struct(F.length("root"), "name")).alias("package"))
    return own.join(deepest, ["repo", "path"], "left").select("repo", "path", F.coalesce(package_label(F.col("package")), module_label(F.col("path"))).alias("label"))


def packages(files: DataFrame) -> DataFrame:
    """repo, path (of the manifest), name, root, needs: the named packages of package.json files and the names they depend on."""
    v = F.try_parse_json("text")
    bags = [F.map_keys(F.try_variant_get(v, f"$.{b}", "map<string,variant>")) for b in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
    needs = F.array_distinct(F.concat(*[F.coalesce(b, F.array().cast("array<string>")) for b in bags]))
    f = files.where((F.col("kind") == "file") & (F.lower(P.basename(F.col("path"))) == "package.json"))
    return f.select("repo", "path", F.try_variant_get(v, "$.name", "string").alias("name"), P.dirname(F.col("path")).alias("root"), needs.alias("needs")).where("name <> ''")


def specifier_maps(files: DataFrame) -> DataFrame:
    """repo, lang, head, tail, whole, to_head, to_tail, ord: what manifests put in place of a specifier's head and tail, least ord first.

    Path aliases of tsconfig and jsconfig files (the longest pattern first), then subpaths of scoped packages; module prefixes of go.mod.
    """
    f = files.where((F.col("kind") == "file") & F.col("text").isNotNull())
    name = F.lower(P.basename(F.col("path")))
    told = F.try_variant_get(F.try_parse_json("text"), "$.compilerOptions.paths", "map<string,array<string>>")
    alias = f.where(name.isin("tsconfig.json", "tsconfig.base.json", "jsconfig.json")).select("repo", "path", F.explode(told).alias("pattern", "to")).withColumn("to", F.try_element_at("to", F.lit(1))).where("to <> ''")
    part = lambda c, i: F.coalesce(F.get(F.split(c, r"\*"), F.lit(i)), F.lit(""))
    to = P.join_path(P.dirname(F.col("path")), F.col("to"))
    row = lambda df, lang, head, tail, whole, to_head, to_tail, kind: df.select(
        "repo", F.lit(lang).alias("lang"), head.alias("head"), tail.alias("tail"), whole.alias("whole"), to_head.alias("to_head"), to_tail.alias("to_tail"), F.struct(F.lit(kind).alias("kind"), (-F.length(head) - F.length(tail)).alias("n"), head.alias("head"), tail.alias("tail")).alias("ord")
    )
    below = lambda root, then="": F.concat(F.when(root != "", F.concat(root, F.lit("/"))).otherwise(""), F.lit(then))
    none, no = F.lit(""), F.lit(False)
    scoped = packages(files).where("startswith(name, '@') and contains(name, '/')")
    modules = f.where(name == "go.mod").select("repo", P.dirname(F.col("path")).alias("root"), F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("name")).where("name <> ''")
    slashed = F.concat("name", F.lit("/"))
    parts = [
        row(alias, "js", part(F.col("pattern"), 0), part(F.col("pattern"), 1), ~F.col("pattern").contains("*"), part(to, 0), part(to, 1), 0),
        row(scoped, "js", slashed, none, no, below(F.col("root"), "src/"), none, 1),
        row(scoped, "js", slashed, none, no, below(F.col("root")), none, 2),
        row(modules, "go", slashed, none, no, below(F.col("root")), none, 0),
    ]
    return reduce(DataFrame.unionByName, parts)


def resolved(references: DataFrame, files: DataFrame) -> DataFrame:
    """references (repo, path, specifier) with ``target``: what the manifests make of a specifier goes before the specifier as it stands.

    A Go import that names a directory means the first Go file in or below it.
    """
    there = files.where("kind = 'file'")
    ext = P.extension(F.col("path"))
    lang = F.when(ext == "go", "go").when(ext.isin("ts", "tsx", "js", "jsx", "mjs", "cjs") & ~F.col("specifier").startswith("."), "js")
    fits = F.when(F.col("whole"), F.col("specifier") == F.col("head")).otherwise(
        F.col("specifier").startswith(F.col("head")) & F.col("specifier").endswith(F.col("tail")) & (F.length("specifier") >= F.length("head") + F.length("tail"))
    )
    met = references.select("repo", "path", "specifier", lang.alias("lang")).distinct().join(specifier_maps(files), ["repo", "lang"]).where(fits)
    mid = F.when(F.col("whole"), "").otherwise(F.substr("specifier", F.length("head") + 1, F.length("specifier") - F.length("head") - F.length("tail")))
    met = met.select("repo", F.col("path").alias("own"), F.col("specifier").alias("said"), "lang", "ord", P.join_path(F.lit(""), F.concat("to_head", mid, "to_tail")).alias("specifier"))
    met = met.withColumn("path", F.when(F.col("lang") == "go", "root.go").otherwise("root.ts"))
    go = there.where(P.extension(F.col("path")) == "go").select("repo", "path", F.explode(P.ancestors(F.col("path"))).alias("specifier"))
    go = go.groupBy("repo", "specifier").agg(F.min("path").alias("within")).withColumn("lang", F.lit("go"))
    hits = resolve(met, there, ["repo"], with_ends=False).join(go, ["repo", "lang", "specifier"], "left").withColumn("target", F.coalesce("target", "within")).where("target is not null")
    best = hits.groupBy("repo", F.col("own").alias("path"), F.col("said").alias("specifier")).agg(F.min_by("target", "ord").alias("mapped"))
    plain = resolve(references, there, ["repo"], with_ends=not references.where(ext.isin(LOOSE)).isEmpty())
    return plain.join(best, ["repo", "path", "specifier"], "left").withColumn("target", F.coalesce("mapped", "target")).drop("mapped")


def package_label(name: Column) -> Column:
    return P.title_case(F.element_at(F.split(name, "/"), -1))


def package_edges(references: DataFrame, files: DataFrame, named: DataFrame) -> DataFrame:
    """repo, source, target, type, confidence, evidence: packages that a manifest needs, and unresolved script imports that name a package.

    ``named``: the labels of the files.
    """
    known = packages(files)
    names = known.select("repo", F.col("name").alias("needed")).distinct()
    needs = known.select("repo", "path", "name", F.explode("needs").alias("needed")).join(names, ["repo", "needed"])
    told = needs.select(
        "repo", package_label(F.col("name")).alias("source"), package_label(F.col("needed")).alias("target"), F.lit("package").alias("type"), F.lit(N.DEPENDENCY_CONFIDENCE["package"]).alias("confidence"),
        F.array(F.concat("path", F.lit(" declares dependency on "), "needed")).alias("evidence"),
    )
    script = references.where(P.extension(F.col("path")).isin("ts", "tsx", "js", "jsx", "mjs", "cjs"))
    scoped = F.regexp_extract("specifier", r"\A(@[^/]*/[^/]*)", 1)
    each = script.select("repo", "path", "specifier", F.explode(F.array_distinct(F.array(F.col("specifier"), scoped))).alias("needed")).join(names, ["repo", "needed"])
    used = each.join(named, ["repo", "path"]).select(
        "repo", F.col("label").alias("source"), package_label(F.col("needed")).alias("target"), F.lit("import").alias("type"), F.lit(N.DEPENDENCY_CONFIDENCE["import"]).alias("confidence"),
        F.array(F.concat("path", F.lit(" references package "), "needed", F.lit(" via "), "specifier")).alias("evidence"),
    )
    return told.unionByName(used)


def references(files: DataFrame) -> DataFrame:
    """repo, path, specifier, type, target (null where it is no file): what the source files refer to. The texts are read once."""
    f = files.where((F.col("kind") == "file") & F.col("text").isNotNull() & P.is_source(F.col("path")))
    return resolved(written(f.select("repo", "path", F.inline(X.typed_references(F.col("text"), P.extension(F.col("path")))))), files)


def dependencies(files: DataFrame, minimum: float = 0.7, refs: DataFrame | None = None) -> DataFrame:
    """repo, source, target, type, confidence, evidence: relations between modules, found in the text of source files and in manifests.

    ``refs``: the references of the files, if they are at hand.
    """
    refs = written(references(files)) if refs is None else refs
    kind = relation_type(F.col("path"), F.col("target"), F.col("type"))
    found = refs.where("target is not null").withColumn("kind", kind)
    named = written(labels(files))
    ends = lambda on, out: named.select("repo", F.col("path").alias(on), F.col("label").alias(out))
    told = found.join(ends("path", "source"), ["repo", "path"]).join(ends("target", "to"), ["repo", "target"])
    verb = F.coalesce(F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])[F.col("kind")], F.lit("imports"))
    sure = F.create_map(*[F.lit(x) for kv in N.DEPENDENCY_CONFIDENCE.items() for x in kv])
    edges = told.select(
        "repo", "source", F.col("to").alias("target"), F.col("kind").alias("type"), sure[F.col("kind")].alias("confidence"), F.array(F.concat_ws(" ", "path", verb, "target")).alias("evidence"),
    )
    edges = edges.unionByName(package_edges(refs.where("target is null"), files, named))
    return merge_dependencies(edges, ["repo"]).where(F.col("confidence") >= minimum)


# Relationships

#: Fixed values: (source role, target role) -> kind, base confidence, strength.
ROLE_PAIRS = {
    ("Controller", "Service"): ("USES", 0.96, "strong"),
    ("Service", "Repository"): ("USES", 0.95, "strong"),
    ("Repository", "Database"): ("USES", 0.94, "strong"),
    ("Route", "Controller"): ("EXPOSES", 0.93, "strong"),
    ("Widget", "Bloc"): ("USES", 0.92, "strong"),
    ("Bloc", "Repository"): ("USES", 0.91, "strong"),
    ("API", "Service"): ("CALLS", 0.9, "strong"),
    ("Module", "Configuration"): ("CONFIGURES", 0.9, "medium"),
    ("Module", "Controller"): ("PROVIDES", 0.88, "medium"),
    ("Module", "Service"): ("PROVIDES", 0.88, "medium"),
    ("Service", "Service"): ("CALLS", 0.8, "weak"),
    ("Controller", "Repository"): ("USES", 0.84, "weak"),
}

def components(files: DataFrame) -> DataFrame:
    """repo, path, name, role, feature of the files whose path tells a role; the name is the class's, else the stem in Pascal case."""
    own = X.class_name(F.coalesce("text", F.lit("")))
    f = files.where((F.col("kind") == "file") & P.is_source(F.col("path"))).withColumn("role", P.role(F.col("path"))).where("role is not null")
    return f.select("repo", "path", F.coalesce(own, P.pascal_case(P.stem(P.basename(F.col("path"))))).alias("name"), "role", P.feature_name(F.col("path")).alias("feature"))


def domains(files: DataFrame, minimum: float = 0.5) -> DataFrame:
    """repo, domain, confidence, first (of its files): domains that words of the paths tell."""
    words = files.where("kind = 'file'").select("repo", "path", F.explode(P.tokens(F.col("path"))).alias("word"))
    per_file = words.join(F.broadcast(lexicon(files.sparkSession)), "word").groupBy("repo", "domain", "path").agg(F.count(F.lit(1)).alias("n"))
    counts = per_file.groupBy("repo", "domain").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_hits"), F.min("path").alias("first"))
    return counts.select("repo", "domain", N.domain_confidence(F.col("n_files"), F.col("n_hits")).alias("confidence"), "first").where(F.col("confidence") >= minimum)


def lexicon(spark) -> DataFrame:
    """word, domain; its size is fixed."""
    words = {w: d for d, ws in reversed(P.DOMAIN_LEXICON.items()) for w in ws}
    return spark.createDataFrame(sorted(words.items()), "word string, domain string")


def _scored(base: Column, strength: Column, n: Column | int, injection: Column | None = None) -> Column:
    return N.relationship_confidence(base, strength, F.lit(False) if injection is None else injection, F.lit(n) if isinstance(n, int) else n)


def _edge(df: DataFrame, source: Column, target: Column, kind: Column, confidence: Column, strength: Column, *evidence: Column) -> DataFrame:
    told = F.array_compact(F.array(*evidence))
    out = df.select("repo", source.alias("source"), target.alias("target"), kind.alias("kind"), confidence.alias("confidence"), strength.alias("strength"), F.lit(False).alias("bidirectional"), told.alias("evidence"))
    return out.dropna(subset=["source", "target"])


def by_roles(parts: DataFrame, files: DataFrame, refs: DataFrame) -> list[DataFrame]:
    """What the roles of importing and imported files say of them: the pair's own relation, features that consume features, configuration."""
    text = F.coalesce("text", F.lit(""))
    signals = files.where("kind = 'file'").select("repo", "path", X.injected(text).alias("given"), X.called(text).alias("calls"))
    found = refs.where("target is not null").select("repo", "path", "target").distinct()
    ends = lambda side, on: parts.select("repo", F.col("path").alias(on), F.col("name").alias(side), F.col("role").alias(f"{side}_role"), F.col("feature").alias(f"{side}_feature"))
    pairs = found.join(ends("source", "path"), ["repo", "path"]).join(ends("to", "target"), ["repo", "target"]).join(signals, ["repo", "path"])
    rule = F.create_map(*[x for (a, b), (k, c, s) in ROLE_PAIRS.items() for x in (F.lit(f"{a}>{b}"), F.struct(F.lit(k).alias("kind"), F.lit(c).alias("base"), F.lit(s).alias("strength")))])
    told = pairs.withColumn("rule", rule[F.concat_ws(">", "source_role", "to_role")]).where("rule is not null")
    injection = F.exists("given", lambda g: (g == F.col("to")) | F.contains(F.lower("target"), F.lower(g)))
    told = told.withColumns({"injection": injection, "call": F.array_contains("calls", F.col("to"))})
    turned = F.col("call") & (F.col("rule.kind") == "USES")
    strength = F.when(F.col("injection"), "strong").otherwise(F.col("rule.strength"))
    told = told.withColumns({"kind": F.when(turned, "CALLS").otherwise(F.col("rule.kind")), "strength": F.when(turned & (strength == "weak"), "medium").otherwise(strength)})
    n = 2 + F.col("injection").cast("int") + F.col("call").cast("int")
    imports = F.concat(F.lit("imports "), P.basename(F.col("target")))
    own = _edge(
        told, F.col("source"), F.col("to"), F.col("kind"), _scored(F.col("rule.base"), F.col("strength"), n, F.col("injection")), F.col("strength"),
        imports, F.when(F.col("injection"), "constructor injection"), F.when(F.col("call"), F.concat(F.lit("calls "), F.col("to"))), F.concat_ws(" → ", "source_role", "to_role"),
    )
    apart = told.where("source_feature <> to_feature and kind in ('USES', 'CALLS')")
    medium, strong = F.lit("medium"), F.lit("strong")
    consumes = _edge(
        apart, F.col("source_feature"), F.col("to_feature"), F.lit("CONSUMES"), _scored(F.lit(0.82), medium, 1), medium,
        F.concat_ws(" ", "source", F.lower("kind"), "to"), F.concat_ws(" → ", "path", "target"),
    )
    wired = pairs.where("source_role = 'Module' and to_role = 'Configuration'")
    configures = _edge(wired, F.col("source"), F.col("to"), F.lit("CONFIGURES"), F.lit(0.92), strong, imports, F.lit("module configuration wiring"))
    return [own, consumes, configures]


def by_packages(parts: DataFrame, files: DataFrame) -> list[DataFrame]:
    """Packages contain the modules and own the features of the files below their manifest; the root's has only the files beside it."""
    manifest = files.where((F.col("kind") == "file") & (P.basename(F.col("path")) == "package.json")).select("repo", P.dirname(F.col("path")).alias("dir"), F.col("path").alias("manifest"))
    above = F.explode(F.when(F.col("path").contains("/"), P.ancestors(F.col("path"))).otherwise(F.array(F.lit(""))))
    inside = join_dimension(parts.withColumn("dir", above), manifest, ["repo", "dir"], "path")
    label = F.when(F.col("dir") == "", "RootPackage").otherwise(P.pascal_case(P.basename(F.col("dir"))))
    strong = F.lit("strong")
    modules, others = inside.where("role = 'Module'"), inside.where("role <> 'Module'")
    return [
        _edge(modules, label, F.col("name"), F.lit("CONTAINS"), F.lit(0.9), strong, F.concat_ws(" package contains ", "manifest", "path")),
        _edge(others, label, F.col("feature"), F.lit("OWNS"), F.lit(0.88), strong, F.concat_ws(" owns path ", "manifest", "path")),
    ]


def relationships(files: DataFrame, minimum: float = 0.75) -> DataFrame:
    """repo, source, target, kind, confidence, strength, bidirectional, evidence: what dependencies, roles, class heads, directories,
    manifests, entrypoints and domains say of the components of a tree."""
    parts, refs = written(components(files)), written(references(files))
    medium, strong = F.lit("medium"), F.lit("strong")
    d = dependencies(files, refs=refs)
    how = F.when(F.col("type") == "dynamic-import", "weak").when(F.col("type") == "package", "strong").otherwise("medium")
    depends = d.select(
        "repo", "source", "target", F.lit("DEPENDS_ON").alias("kind"), _scored(F.least("confidence", F.lit(0.95)), how, F.size("evidence")).alias("confidence"), how.alias("strength"),
        F.lit(False).alias("bidirectional"), F.transform("evidence", lambda e: F.concat(F.lit("dependency: "), e)).alias("evidence"),
    )
    heads = files.where("kind = 'file' and text is not null").select("repo", "path", F.explode(X.implemented(F.col("text"))).alias("base")).join(parts, ["repo", "path"])
    implements = _edge(heads, F.col("name"), F.col("base"), F.lit("IMPLEMENTS"), _scored(F.lit(0.97), strong, 1), strong, F.concat(F.lit("implements "), "base"), F.concat(F.lit("in "), "path"))
    contains = _edge(parts.where("feature <> name"), F.col("feature"), F.col("name"), F.lit("CONTAINS"), _scored(F.lit(0.86), strong, 1), strong, F.concat_ws(" lives under feature ", "path", "feature"))
    entries = entrypoints.discover(files.where("kind = 'file'")).join(parts.select("repo", "path", "name"), ["repo", "path"], "left")
    entry = F.coalesce("name", P.pascal_case(P.stem(P.basename(F.col("path")))))
    seen = lambda i: F.concat(F.lit("entry evidence: "), F.get("evidence", F.lit(i)))
    enters = _edge(entries, entry, P.feature_name(F.col("path")), F.lit("ENTERS"), _scored(F.least("confidence", F.lit(0.92)), medium, F.size("evidence")), medium, F.concat(F.lit("entrypoint "), "path"), seen(0), seen(1))
    words = parts.where("feature is not null").select("repo", "path", "feature", F.explode(P.tokens(F.col("path"))).alias("word")).join(F.broadcast(lexicon(files.sparkSession)), "word")
    of = join_dimension(words, domains(files), ["repo", "domain"], "path")
    provides = _edge(
        of, F.col("feature"), F.col("domain"), F.lit("PROVIDES"), _scored(F.least("confidence", F.lit(0.9)), medium, 1), medium,
        F.concat("path", F.lit(' token "'), "word", F.lit('" maps to domain '), "domain"), F.concat(F.lit("domain evidence: "), "first"),
    )
    edges = reduce(DataFrame.unionByName, [depends, *by_roles(parts, files, refs), implements, contains, *by_packages(parts, files), enters, provides])
    return mark_bidirectional(written(merge_relationships(edges, ["repo"])), ["repo"]).where(F.col("confidence") >= minimum)


# Fix plans

#: Rules with a safe fix, and where an agent's exclusions are kept.
FIXABLE = ["context/generated-directory", "context/large-log-file"]
TARGETS = {"claude-code": ".claude/settings.json", "codex": ".codex/config.toml", "cursor": ".cursorignore"}


def fix_plan(findings: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions (repo, agent, target, pattern, finding paths) and skips (repo, rule_id, path, reason). ``present``: repo, agent of the agents set up."""
    pattern = F.when(F.col("rule_id") == FIXABLE[0], F.concat(F.regexp_replace("path", r"/\z", ""), F.lit("/"))).otherwise(F.col("path"))
    rows = findings.withColumn("fits", F.col("rule_id").isin(FIXABLE))
    each = rows.where("fits").select("repo", "rule_id", "path", pattern.alias("pattern"), F.explode("agents").alias("agent")).join(present.select("repo", "agent", F.lit(True).alias("set_up")), ["repo", "agent"], "left")
    where = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])
    actions = each.where("set_up").withColumn("target", where[F.col("agent")]).where("target is not null")
    actions = actions.groupBy("repo", "agent", "target", "pattern").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    reasons = [
        rows.where("not fits").select("repo", "rule_id", "path", F.lit("no safe fix for this rule").alias("reason")),
        each.where("set_up is null").select("repo", "rule_id", "path", F.concat("agent", F.lit(" is not set up")).alias("reason")),
    ]
    return actions, reduce(DataFrame.unionByName, reasons)


def skip_histogram(skips: DataFrame) -> DataFrame:
    return skips.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")
