"""Paths and names: tokens, labels, folding, classes, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataform.functions.clean import strip

#: Segments that carry no domain meaning.
STOP_SEGMENTS = (
    "src lib libs app apps packages package modules module internal cmd bin dist build out public static assets styles css js ts tsx jsx mjs cjs"
    " py go rs java kt php rb dart test tests spec specs __tests__ fixtures mocks mock stub stubs types type typings interfaces interface utils util"
    " helpers helper common shared core index main init config configs constants constant models model dto entity entities repository repositories"
    " service services controller controllers handler handlers middleware route routes router api v1 v2 v3 http grpc graphql component components"
    " hook hooks page pages view views provider providers store stores context contexts domain domains feature features node_modules vendor"
).split()

#: Synonyms of each domain; the first domain that has a word keeps it.
DOMAIN_LEXICON = {
    "Payments": "payment payments billing invoice invoices checkout stripe paypal refund refunds subscription subscriptions charge charges".split(),
    "Auth": "auth authentication authorization login logout oauth oidc sso session sessions password passwords jwt rbac".split(),
    "Users": "user users account accounts profile profiles identity identities".split(),
    "Orders": "order orders cart carts checkoutcart fulfillment".split(),
    "Notifications": "notification notifications notify email emails mailer sms push webhook webhooks".split(),
    "Inventory": "inventory stock sku skus warehouse catalog catalogue".split(),
    "Shipping": "shipping shipment shipments delivery logistics carrier".split(),
    "Admin": "admin admins backoffice dashboard".split(),
    "Analytics": "analytics metrics telemetry tracking reporting reports".split(),
    "Search": "search elasticsearch opensearch solr indexer indexing".split(),
}

#: Directory names of samples and tests, and words that mark a compound segment as such.
SAMPLE_DIRECTORIES = (
    "example examples fixture fixtures __fixtures__ integration integrations mock mocks __mocks__ sample samples test tests testing __tests__"
    " testdata test_data spec specs demo demos e2e bench benchmark benchmarks playground playgrounds sandbox sandboxes"
).split()
TEST_WORDS = (
    "test tests testing fixture fixtures mock mocks testdata spec specs e2e bench benchmark benchmarks playground playgrounds sandbox sandboxes"
    " example examples sample samples demo demos"
).split()

#: Extensions of source files.
SOURCE_EXTENSIONS = "ts tsx js jsx mjs cjs py go rs java php dart".split()


def tokens(path: Column) -> Column:
    """Lower-case words of a path: without the last extension, cut at / _ . - and before capitals, short, numeric and stop words left out."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.[A-Za-z0-9]+\z", "")
    pieces = F.split(F.regexp_replace(plain, "([a-z0-9])(?=[A-Z])", "$1/"), "[/_.-]+")
    words = F.transform(pieces, F.lower)
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_SEGMENTS) & ~w.rlike(r"\A[0-9]+\z"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))


def is_source(path: Column) -> Column:
    return extension(path).isin(SOURCE_EXTENSIONS)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """'' for a file at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+\z", "")


def is_root_level(path: Column) -> Column:
    return ~path.contains("/")


def join_path(base: Column, relative: Column) -> Column:
    """base/relative with . and .. folded; .. at the root changes nothing."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(folded, "/")


def suffixes(path: Column) -> Column:
    """Every run of last segments of a path, longest first: a/b/c, b/c, c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest last: a/b/c gives a, a/b."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(
        F.array().cast("array<string>")
    )


def pascal_case(name: Column) -> Column:
    words = F.filter(F.split(name, r"[._\-/]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def title_case(segment: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(segment, r"\A@", ""), r"[^a-zA-Z0-9_-]", "")
    words = F.filter(F.split(plain, r"[-_]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")
    return F.when(joined == "", segment).otherwise(joined)


#: Directories that name no feature.
NO_FEATURE = "src lib app apps packages services modules controllers controller service repositories repository routes config main java kotlin".split()


def feature_name(path: Column) -> Column:
    """The first directory that is an identifier of two letters or more and no stop word, in Pascal case; null if none."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    good = F.filter(dirs, lambda d: ~F.lower(d).isin(NO_FEATURE) & d.rlike(r"\A[a-zA-Z][A-Za-z0-9_-]+\z"))
    return pascal_case(F.try_element_at(good, F.lit(1)))


def is_sample_segment(segment: Column) -> Column:
    low = F.lower(segment)
    words = F.filter(F.split(low, "[-_]+"), lambda w: w != "")
    compound = (F.size(words) >= 2) & F.exists(words, lambda w: w.isin(TEST_WORDS))
    camel = F.transform(F.split(F.regexp_replace(F.regexp_replace(segment, "([a-z0-9])([A-Z])", "$1/$2"), "([A-Z]+)([A-Z][a-z])", "$1/$2"), "/"), F.lower)
    return (
        low.isin(SAMPLE_DIRECTORIES)
        | (low.startswith("_") & F.regexp_replace(low, r"\A_+", "").isin(SAMPLE_DIRECTORIES))
        | compound
        | (segment.rlike("[A-Z]") & F.exists(camel, lambda w: w.isin(TEST_WORDS)))
    )


def is_sample_path(path: Column) -> Column:
    """Some segment is a sample's or a test's; a last segment that looks like a file does not count."""
    parts = F.split(path, "/")
    dirs = F.when(F.element_at(parts, -1).contains("."), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.exists(dirs, is_sample_segment)


def env_class(path: Column) -> Column:
    """backup, template, runtime or null by the name of an environment file."""
    name = strip(basename(path))
    low = F.lower(name)
    return (
        F.when(low.isin(".env_backup", ".env_old", ".env_local"), "backup")
        .when(low.startswith(".env") & (low.isin(".env.example", ".env.sample", ".env.template", ".env.dist") | low.rlike(r"\.(?:example|sample|template)(?:\.|\z)")), "template")
        .when((low == ".env") | name.rlike(r"\A\.env\.[A-Za-z0-9_.-]+\z"), "runtime")
    )


#: Private material by file name (pattern, exception, label); the first that matches.
KEY_FILES = [
    (r"\Aid_(rsa|ed25519|ecdsa)\z", None, "SSH private key"),
    (r"\.pem\z", "cert|certificate|public|ca-bundle", "PEM private key"),
    (r"\.der\z", "cert|certificate|public|ca-bundle", "DER-encoded key or credential material"),
    (r"\.(p12|pfx)\z", None, "PKCS#12 credential bundle"),
    (r"\Acredentials\.json\z", None, "credentials file"),
    (r"service[-_]?account.*\.json\z", None, "service account key"),
    (r"\.key\z", "public|pub", "private key file"),
]


def key_file_class(path: Column) -> Column:
    """The kind of private-key file by name; null for others."""
    name = F.lower(basename(path))
    out = F.when(F.lit(False), "")
    for pattern, exception, label in KEY_FILES:
        out = out.when(name.rlike(pattern) & (~name.rlike(exception) if exception else F.lit(True)), label)
    return out


def is_log_like(path: Column) -> Column:
    return F.lower(basename(path)).rlike(r"\.(log|out|dump)\z") | F.lower(path).rlike(r"(^|/)(debug|trace|coverage-final|chrome-devtools|heapdump)")


def size_class(n_bytes: Column, info: int = 16 << 10, warning: int = 32 << 10) -> Column:
    return F.when(n_bytes >= warning, "warning").when(n_bytes >= info, "info")


#: Role of a component by its path, the first that matches.
ROLES = [
    ("Module", r"\.module\.(t|j)sx?\z"),
    ("Configuration", r"(^|/|[-_.])config(uration)?([-_.]|\z)"),
    ("Controller", r"(^|/|[-_.])controllers?([-_.]|\z)|controller\.(t|j)sx?\z"),
    ("Service", r"(^|/|[-_.])services?([-_.]|\z)|service\.(t|j)sx?\z"),
    ("Repository", r"(^|/|[-_.])repositor(y|ies)([-_.]|\z)|repository\.(t|j)sx?\z"),
    ("Database", r"(^|/|[-_.])(entity|entities|schema|models?|prisma|migration)([-_.]|\z)"),
    ("Route", r"(^|/)routes?/|(^|/|[-_.])router([-_.]|\z)|routes?\.(t|j)sx?\z|web\.php\z"),
    ("Widget", r"widget\.(dart|tsx?|jsx?)\z|_widget\.dart\z"),
    ("Bloc", r"bloc\.(dart|tsx?)\z|cubit\.dart\z"),
    ("EntryPoint", r"(^|/)main\.(t|j)sx?\z|(^|/)main\.dart\z|(^|/)index\.(t|j)sx?\z"),
    ("API", r"(^|/)api/[^/]+\z|api\.(t|j)sx?\z"),
]


def role(path: Column) -> Column:
    low = F.lower(path)
    out = F.when(F.lit(False), "")
    for name, pattern in ROLES:
        out = out.when(low.rlike(pattern), name)
    return out


# Patterns: a glob becomes one regular expression, once per pattern and on the driver.


def _glob(body: str) -> str:
    """* stays within a segment, ** crosses segments, ? is one character of a segment."""
    parts = re.split(r"(\*\*|\*|\?)", body)
    return "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)


def ignore_regex(pattern: str) -> str:
    """An ignore pattern (without its !) as a regex over a relative path, by the pattern's shape: name/ a/b/ /rooted a/b or name."""
    if pattern.endswith("/"):
        body = _glob(pattern[:-1])
        return f"^(?:.*/)?{body}(?:/.*)?$" if "/" not in pattern[:-1] else f"^{body}(?:/.*)?$"
    if pattern.startswith("/"):
        return f"^{_glob(pattern[1:])}$"
    body, literal = _glob(pattern), re.escape(pattern)
    if "/" in pattern:
        return f"^(?:{body}(?:/.*)?|.*/{literal}|{literal}/.*)$"
    return f"^(?:(?:.*/)?{body}|(?:.*/)?{literal}(?:/.*)?)$"


def rebase_pattern(base: str, pattern: str) -> str:
    """A nested ignore file's pattern, relative to the root."""
    if base in ("", "."):
        return pattern
    sign, body = ("!", pattern[1:]) if pattern.startswith("!") else ("", pattern)
    return f"{sign}{base}/{body.removeprefix('**/').removeprefix('/')}"


def ignore_lines(text: str) -> list[str]:
    lines = (x.strip() for x in re.split(r"\r?\n", text))
    return [x.replace("\\ ", " ") for x in lines if x and not x.startswith("#")]


def owners_regex(pattern: str) -> str:
    """An owners pattern: rooted if it starts with a slash, a directory's whole content if it ends with one."""
    body = pattern.strip()
    rooted, directory = body.startswith("/"), body.endswith("/")
    inner = _glob(body.removeprefix("/").removesuffix("/"))
    return ("^" if rooted else "(^|/)") + inner + ("(/.*)?$" if directory else "$")


# The same as columns, for patterns that are rows.


def literal_of(text: Column) -> Column:
    """A text as a regular expression that means itself."""
    return F.regexp_replace(text, r"[.+*?^${}()|\[\]\\]", r"\\$0")


def glob_of(body: Column) -> Column:
    escaped = F.regexp_replace(body, r"[.+^${}()|\[\]\\]", r"\\$0")
    marked = F.replace(F.replace(F.replace(escaped, F.lit("**"), F.lit("\x00")), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.replace(marked, F.lit("\x00"), F.lit(".*"))


def ignore_regex_of(pattern: Column) -> Column:
    """ignore_regex for a column of patterns."""
    inner = F.regexp_replace(pattern, r"/\z", "")
    folder = F.when(inner.contains("/"), F.concat(F.lit("^"), glob_of(inner), F.lit("(?:/.*)?$"))).otherwise(F.concat(F.lit("^(?:.*/)?"), glob_of(inner), F.lit("(?:/.*)?$")))
    rooted = F.concat(F.lit("^"), glob_of(F.regexp_replace(pattern, r"\A/", "")), F.lit("$"))
    body, literal = glob_of(pattern), literal_of(pattern)
    nested = F.concat(F.lit("^(?:"), body, F.lit("(?:/.*)?|.*/"), literal, F.lit("|"), literal, F.lit("/.*)$"))
    name = F.concat(F.lit("^(?:(?:.*/)?"), body, F.lit("|(?:.*/)?"), literal, F.lit("(?:/.*)?)$"))
    return F.when(pattern.endswith("/"), folder).when(pattern.startswith("/"), rooted).when(pattern.contains("/"), nested).otherwise(name)


def owners_regex_of(pattern: Column) -> Column:
    """owners_regex for a column of patterns; * alone covers everything."""
    body = F.trim(pattern)
    inner = glob_of(F.regexp_replace(F.regexp_replace(body, r"\A/", ""), r"/\z", ""))
    return F.when(body == "*", ".*").otherwise(F.concat(F.when(body.startswith("/"), "^").otherwise("(^|/)"), inner, F.when(body.endswith("/"), "(/.*)?$").otherwise("$")))


def folded(base: Column, relative: Column) -> Column:
    """base/relative with . and .. folded; what leads out of the root keeps its leading .. segments."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(base, F.lit("")), relative), "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc: (F.size(acc) == 0) | (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) == "..")
    out = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & ~up(acc), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(out, "/")


def leads_out(path: Column) -> Column:
    return (path == "..") | path.startswith("../")
