"""Import resolution as joins: references name candidates in order, files offer keys, the first candidate that is a key wins.

Where a language falls back to "some file whose path ends so", the ends of all paths are keys as well, so that no reference is ever
compared with every file. The endings tried behind a candidate are cut off the files' names instead, once per file: a name has one or two
of them, a reference would have to be repeated for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions import paths as P

#: Extensions tried behind a candidate, in order.
TRIED = (
    [""]
    + ".ts .tsx .js .jsx .mjs .cjs .dart .java .go .py .rs .php".split()
    + "/index.ts /index.tsx /index.js /index.jsx /index.mjs /index.dart /__init__.py /mod.rs".split()
)


#: Languages that fall back to the ends of paths.
LOOSE = ["py", "java", "php", "dart"]


def file_keys(files: DataFrame, scope: list[str], with_ends: bool = True) -> DataFrame:
    """scope, key, exact, tried, target: every candidate that some file answers, and the place in TRIED of the ending it lacks, the first of several.

    Exact names: the path, the path without extension, the directory of an index file. Other names, without endings: the ends of the path
    without extension. Of several files with the same name the first in path order answers.
    """
    f = files.select(*scope, "path").dropna()
    plain = P.stem(F.col("path"))
    index = F.col("path").rlike(r"/(index\.(ts|js)|__init__\.py|mod\.rs)\z")
    name = lambda k, rank: F.struct(k.alias("name"), F.lit(rank).alias("rank"))
    key = lambda k, exact, tried, rank: F.struct(k.alias("key"), F.lit(exact).alias("exact"), tried.alias("tried"), rank.alias("rank"))
    names = F.filter(F.array(name(F.col("path"), 0), name(plain, 1), name(F.when(index, P.dirname(F.col("path"))), 2)), lambda n: n["name"] != "")
    endings = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(k).alias("k")) for k, e in enumerate(TRIED)])
    cut = lambda n, t: F.left(n["name"], F.length(n["name"]) - F.length(t["e"]))
    exact = F.transform(names, lambda n: F.transform(F.filter(endings, lambda t: F.endswith(n["name"], t["e"])), lambda t: key(cut(n, t), True, t["k"], n["rank"])))
    ends = F.transform(F.filter(P.suffixes(plain), lambda s, i: (i > 0) & (s != "")), lambda s: key(s, False, F.lit(0), F.lit(3)))
    keyed = f.select(*scope, "path", F.inline(F.concat(F.flatten(exact), ends) if with_ends else F.flatten(exact)))
    # An exact key begins its path, so the rest of the path is enough, and of paths with the same beginning the rests are in path order.
    rest = F.when(F.col("exact"), F.substr("path", F.length("key") + 1)).otherwise(F.col("path"))
    first = keyed.groupBy(*scope, "key", "exact").agg(F.min(F.struct("tried", "rank", rest.alias("rest"))).alias("m"))
    return first.select(*scope, "key", "exact", "m.tried", F.when(F.col("exact"), F.concat("key", "m.rest")).otherwise(F.col("m.rest")).alias("target"))


def candidates(from_path: Column, specifier: Column) -> Column:
    """Ordered candidates of a reference by the language of its file: array of (key, exact)."""
    ext = P.extension(from_path)
    here = P.dirname(from_path)
    dotted = F.replace(specifier, F.lit("."), F.lit("/"))
    spec = F.regexp_replace(specifier, r"\\", "/")
    one = lambda k, exact=True: F.struct(k.alias("key"), F.lit(exact).alias("exact"))
    typed = F.regexp_replace(spec, r"\.(?:jsx?|mjs|cjs)\z", "")
    script = F.when(spec.startswith("."), F.array(one(P.join_path(here, spec)), one(P.join_path(here, typed)))).otherwise(F.array(one(spec), one(typed)))
    dots = F.length(F.regexp_extract(specifier, r"\A\.+", 0))
    up = F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))), "/")
    inner = F.replace(F.regexp_replace(specifier, r"\A\.+", ""), F.lit("."), F.lit("/"))
    python = F.when(specifier.startswith("."), F.array(one(P.join_path(P.join_path(here, up), inner)))).otherwise(
        F.array(one(dotted), one(P.join_path(here, dotted)), one(dotted, False))
    )
    java = F.array(one(dotted), one(F.concat(F.lit("src/main/java/"), dotted)), one(dotted, False))
    crate = F.when(from_path.contains("/src/"), F.regexp_extract(from_path, r"\A(.*?/src)/", 1)).otherwise(here)
    head = F.split(F.regexp_replace(specifier, r"\A(?:crate|super|self)::", ""), "::")[0]
    rust = (
        F.when(specifier.startswith("crate::"), F.array(one(P.join_path(crate, head))))
        .when(specifier.startswith("super::"), F.array(one(P.join_path(P.dirname(here), head))))
        .otherwise(F.array(one(P.join_path(here, head))))
    )
    app = F.regexp_replace(spec, r"\AApp/", "app/")
    php = F.array(one(app), one(P.stem(app)), one(P.basename(app), False))
    package = F.regexp_replace(specifier, r"\Apackage:[^/]*/", "")
    dart = F.when(specifier.startswith("package:"), F.array(one(P.stem(package), False))).otherwise(F.array(one(P.join_path(here, spec))))
    return (
        F.when(ext == "py", python).when(ext == "java", java).when(ext == "rs", rust).when(ext == "php", php).when(ext == "dart", dart).when(ext == "go", F.array(one(spec))).otherwise(script)
    )


def resolve(references: DataFrame, files: DataFrame, scope: list[str], with_ends: bool = True) -> DataFrame:
    """references (scope, path, specifier, ...) with ``target``, the file meant, or null. Repeated references stay rows of their own.

    ``with_ends``: False if no path of the references is of a language in LOOSE, so that nothing asks for the ends of files' paths.

    Two shuffle joins at most: references meet the keys of their scope, and the targets come back to all references.
    """
    refs = references.select(*scope, "path", "specifier").dropna()
    wanted = refs.select(*scope, "path", "specifier", F.posexplode(F.array_distinct(candidates(F.col("path"), F.col("specifier")))).alias("i", "c"))
    hits = wanted.select(*scope, "path", "specifier", "i", "c.key", "c.exact").join(file_keys(files, scope, with_ends), [*scope, "key", "exact"])
    best = hits.groupBy(*scope, "path", "specifier").agg(F.min_by("target", F.struct("i", "tried")).alias("target"))
    return references.join(best, [*scope, "path", "specifier"], "left")
