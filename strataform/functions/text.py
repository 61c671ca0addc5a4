"""Text content: normal forms, references inside text, secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions import paths
from strataform.functions.clean import strip

_ENDS = r"\A[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+\z"


def strip_frontmatter(text: Column) -> Column:
    """A leading block between --- lines goes; without its end the text stays."""
    return F.regexp_replace(text, r"\A---(?s:.*?)\n---", "")


def normal_content(text: Column) -> Column:
    """One form for equal bodies: LF line ends, no blanks at line ends, at most one empty line, trimmed, lower case, no front matter."""
    t = F.replace(strip_frontmatter(text), F.lit("\r\n"), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.lower(F.regexp_replace(t, _ENDS, ""))


#: Extensions that make a bare name a file, hosts of module paths, roots of a standard library, words that only look like
#: paths, roots that a build makes.
BARE_FILE = r"(?i)\.(mdc?|txt|tsx?|jsx?|mjs|cjs|json|ya?ml|toml|php|py|rb|go|rs|java|kt|css|scss|html|vue|svelte|sh|bash|zsh|sql|xml|svg|png|jpe?g|gif|webp|wasm|lock)\z"
MODULE_HOST = r"(?i)\A(?:[a-z0-9-]+\.)+(?:com|org|net|io|dev|ai|app|cloud|co|edu|gov|info|me|tv|xyz|in|to|cc)(?:/|\z)"
GO_ROOTS = (
    "archive bufio bytes cmp compress container context crypto database debug embed encoding errors expvar flag fmt go hash html image index io log maps math mime net os path plugin"
    " reflect regexp runtime slices structs sync syscall testing text time unicode unique unsafe weak"
).split()
SLASH_WORDS = r"(?i)\A(?:try/finally|if/else|for/of|for/in|async/await|do/while)\z"
BUILD_ROOTS = ["dist", "build", "out", "target", ".next", "coverage"]


def path_candidates(text: Column) -> Column:
    """Distinct targets of markdown links and back-tick spans, trimmed, up to an anchor."""
    links = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    spans = F.regexp_extract_all(text, F.lit(r"`([^`]+)`"), F.lit(1))
    return F.array_distinct(F.transform(F.array_union(links, spans), lambda c: F.regexp_replace(strip(c), r"(?s)#.*\z", "")))


def is_local_reference(c: Column) -> Column:
    """A candidate that may be a path of this tree; precision goes before recall."""
    plain = F.regexp_replace(c, r"/+\z", "")
    parts = F.split(plain, "/")
    go = F.size(parts).between(2, 4) & parts[0].isin(GO_ROOTS) & F.forall(parts, lambda p: p.rlike(r"\A[a-z][a-z0-9]*\z"))
    nested = ~F.exists(parts, lambda p: p == "") & ~plain.rlike(MODULE_HOST) & ~go
    return (
        (c != "")
        & (F.length(c) <= 200)
        & ~c.rlike(r"(?i)\A(?:https?:|mailto:|file:)|\A#|\A--|://|[\n ]|[;&|$]|\A/|\A[A-Za-z]:[\\/]|\A\.[A-Za-z_][\w-]*\z|\A@[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+|[*?\[\]{}]")
        & ~c.rlike(SLASH_WORDS)
        & ~F.regexp_replace(F.regexp_replace(c, r"\A\./", ""), r"/+\z", "").isin(BUILD_ROOTS)
        & F.when(c.contains("/"), nested).otherwise(c.rlike(BARE_FILE) & ~c.startswith("."))
    )


def concrete(c: Column) -> Column:
    """The candidate decoded and with slashes; null where it is a placeholder, an ellipsis, a home path, a branch or a bundler's module type."""
    decoded = F.when(c.contains("%"), F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))).otherwise(c)
    n = F.replace(decoded, F.lit("\\"), F.lit("/"))
    branch = n.rlike(r"\A(?:origin|upstream|HEAD)/[A-Za-z0-9._/-]+\z") | (n.rlike(r"\A(?:feature|fix|chore|hotfix|release)/[A-Za-z0-9._/-]+\z") & ~n.rlike(r"\.[A-Za-z0-9]{1,16}\z"))
    odd = n.rlike(r"<[^<>\s]+>|\{[A-Za-z_][A-Za-z0-9_]*\}|(?:^|/)\.\.\.(?:/|\z)|\A~(?:/|\z)|\A(?:asset|javascript|css|json|wasm|webassembly|runtime)/[A-Za-z0-9_-]+\z")
    return F.when((n != "") & ~branch & ~odd, n)


def local_references(text: Column) -> Column:
    """The distinct candidates of a text that may be paths of its tree."""
    return F.filter(path_candidates(text), lambda c: is_local_reference(c) & concrete(c).isNotNull())


def reference_tries(refs: DataFrame) -> DataFrame:
    """Adds ``tries`` to references (path, ref): the paths each may mean, none if it leads out of the tree.

    With ./ or ../ it is read from the file's own directory, else from the root and from there.
    """
    ref, base = concrete(F.col("ref")), paths.dirname(F.col("path"))
    explicit = ref.rlike(r"\A\.\.?/")
    near, root = paths.folded(base, ref), paths.folded(F.lit(""), ref)
    inside = lambda *ps: F.array_distinct(F.filter(F.array(*ps), lambda p: ~paths.leads_out(p)))
    out = F.array().cast("array<string>")
    return refs.withColumn("tries", F.when(explicit, inside(near)).when(paths.leads_out(root), out).otherwise(inside(root, near)))


#: Words that mark a secret, and names of sensitive files.
SECRETISH = r"(?i)(password|secret|token|api[_-]?key|private[_-]?key|credential)"
SENSITIVE_NAME = r"(?i)(\A\.env(\..+)?\z|credentials.*\.json\z|secret|id_rsa\z|id_ed25519\z|\.pem\z|\.key\z)"


def is_sensitive(locator: Column) -> Column:
    return F.regexp_extract(locator, r"[^/\\]*\z", 0).rlike(SENSITIVE_NAME) | locator.rlike(SECRETISH)


def redact_locator(locator: Column) -> Column:
    """A sensitive locator keeps its directory only; one without a directory goes altogether."""
    folder = F.regexp_replace(F.regexp_replace(locator, r"[^/\\]*\z", ""), r"[/\\]", "/")
    return F.when(~is_sensitive(locator), locator).when(folder == "", "[REDACTED_PATH]").otherwise(F.concat(folder, F.lit("[REDACTED_NAME]")))


def redact_symbol(symbol: Column) -> Column:
    return F.when(symbol.rlike(SECRETISH), "[REDACTED]").otherwise(symbol)


def printable(text: Column) -> Column:
    """Without control characters, tabs and line ends excepted."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def references(text: Column, extension: Column) -> Column:
    """Specifiers that a source text imports, by language of the extension; repeats stay."""
    find = lambda p, g=1: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    script = F.concat(
        find(r"(?m)\b(?:import|export)\b[^'\"\n;()]*?['\"]([^'\"\n]+)['\"]"),
        find(r"\brequire\(\s*['\"]([^'\"\n]+)['\"]\s*\)"),
        find(r"\bimport\(\s*['\"]([^'\"\n]+)['\"]\s*\)"),
    )
    kept = lambda c: F.filter(c, lambda r: ~r.startswith("node:") & ~r.isin(".", "./", "../"))
    return (
        F.when(extension.isin("ts", "tsx", "js", "jsx", "mjs", "cjs"), kept(script))
        .when(extension == "py", F.concat(find(r"(?m)^\s*from\s+([\w.]+)\s+import\b"), find(r"(?m)^\s*import\s+([\w.]+)")))
        .when(extension == "java", F.filter(find(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"), lambda r: ~r.rlike(r"^(java|javax|jakarta)\.")))
        .when(extension == "go", find(r"(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$"))
        .when(extension == "rs", F.concat(find(r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)"), find(r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;")))
        .when(extension == "php", F.concat(find(r"(?m)^\s*use\s+([\w\\]+)"), find(r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"\n]+)['\"]")))
        .when(extension == "dart", find(r"(?m)^\s*(?:import|export|part)\s+['\"]([^'\"\n]+)['\"]"))
        .otherwise(F.array().cast("array<string>"))
    )


#: How each language refers to other files, and what kind of relation each form is.
_QUOTED = r"[\"'`]([^\"'`]+)[\"'`]"
REFERENCE_FORMS = {
    ("ts", "tsx", "js", "jsx", "mjs", "cjs"): [
        ("import", r"\bimport\s+(?:type\s+)?(?:[\w*{}$,\s]+\s+from\s+)?" + _QUOTED),
        ("export", r"\bexport\s+(?:\*|\{[^}]*\})\s+from\s+" + _QUOTED),
        ("require", r"\brequire\s*\(\s*" + _QUOTED + r"\s*\)"),
        ("dynamic-import", r"\bimport\s*\(\s*" + _QUOTED + r"\s*\)"),
    ],
    ("dart",): [("import", r"\bimport\s+['\"]([^'\"]+)['\"]"), ("export", r"\bexport\s+['\"]([^'\"]+)['\"]")],
    ("rs",): [("import", r"\buse\s+((?:crate|super|self)::[\w:]+|[\w]+(?:::[\w]+)+)\s*(?:;|::\{)"), ("module", r"\bmod\s+([a-zA-Z_][\w]*)\s*;")],
    ("php",): [
        ("import", r"\buse\s+([A-Za-z_\\][\w\\]*)\s*;"),
        ("require", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]"),
        ("route", r"\[([A-Za-z_\\][\w\\]*)\s*::\s*class"),
    ],
}


def typed_references(text: Column, extension: Column) -> Column:
    """Distinct (specifier, type) that a source text refers to; languages with one form only have imports."""
    as_type = lambda t: lambda s: F.struct(strip(s).alias("specifier"), F.lit(t).alias("type"))
    out = F.when(F.lit(False), F.array().cast("array<struct<specifier:string,type:string>>"))
    for extensions, forms in REFERENCE_FORMS.items():
        found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), as_type(t)) for t, p in forms]
        out = out.when(extension.isin(*extensions), F.concat(*found))
    out = out.otherwise(F.transform(references(text, extension), as_type("import")))
    return F.array_distinct(F.filter(out, lambda r: ~r["specifier"].startswith("node:") & ~r["specifier"].isin("", ".", "./", "../")))


#: What a text says of classes it is given, implements or calls.
INJECTED = [
    r"constructor\s*\(\s*(?:private|public|protected|readonly|\s)*\s*(?:readonly\s+)?[A-Za-z_][\w]*\s*:\s*([A-Z][A-Za-z0-9_]*)",
    r"@Inject(?:Repository)?\s*\(\s*([A-Z][A-Za-z0-9_]*)",
    r"constructor\s*\([^)]*\b([A-Z][A-Za-z0-9_]*(?:Service|Repository|Bloc|Controller))\b",
]
IMPLEMENTED = r"\bimplements\s+([A-Z][A-Za-z0-9_]*(?:\s*,\s*[A-Z][A-Za-z0-9_]*)*)"
CALLED = r"\b([A-Z][A-Za-z0-9_]*(?:Service|Repository|Controller|Bloc))\s*\.\s*[a-zA-Z_]"
CLASS_NAMES = [r"\bexport\s+(?:default\s+)?class\s+([A-Z][A-Za-z0-9_]*)", r"\bclass\s+([A-Z][A-Za-z0-9_]*)\b", r"\bexport\s+(?:default\s+)?(?:function|const)\s+([A-Z][A-Za-z0-9_]*)"]


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def injected(text: Column) -> Column:
    return F.array_distinct(F.concat(*[_all(text, p) for p in INJECTED]))


def implemented(text: Column) -> Column:
    names = F.flatten(F.transform(_all(text, IMPLEMENTED), lambda l: F.split(l, ",")))
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != ""))


def called(text: Column) -> Column:
    return F.array_distinct(_all(text, CALLED))


def class_name(text: Column) -> Column:
    """The class, function or constant a source text is about; null without."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in CLASS_NAMES])
