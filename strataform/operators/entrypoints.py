"""Entrypoints: every file against a table of framework models, by path and by signals in the text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.numbers import entrypoint_confidence


@dataclass(frozen=True)
class Model:
    framework: str
    path: str
    signals: tuple[tuple[str, str], ...]
    base: float
    boost: float
    needs_signal: bool
    not_path: str = r"\A\z"


#: The models, in order.
MODELS = (
    Model("Flutter", r"(^|/)main\.dart\z", (("runApp()", r"\brunApp\s*\("), ("MaterialApp", r"\bMaterialApp\b"), ("CupertinoApp", r"\bCupertinoApp\b"), ("GoRouter", r"\bGoRouter\b")), 0.7, 0.1, False),
    Model(
        "Laravel", r"(^|/)routes/(web|api)\.php\z|(^|/)artisan\z|(^|/)bootstrap/app\.php\z",
        (("Route::", r"\bRoute\s*::"), ("Illuminate\\", r"Illuminate\\"), ("Application::configure", r"Application\s*::\s*configure")), 0.85, 0.05, False,
    ),
    Model(
        "Next.js", r"(^|/)app/(.*/)?(layout|page)\.(tsx|jsx|js)\z|(^|/)pages/(.*/)?(_app|index)\.(tsx|jsx|js)\z",
        (
            ("next/navigation", r"from\s+[\"']next/navigation[\"']"), ("next/router", r"from\s+[\"']next/router[\"']"), ("next/head", r"from\s+[\"']next/head[\"']"),
            ("Metadata", r"\bexport\s+(const|async\s+function|function)\s+metadata\b"),
        ), 0.8, 0.06, False,
    ),
    Model("NestJS", r"(^|/)main\.(ts|js)\z", (("NestFactory", r"\bNestFactory\b"), ("bootstrap()", r"\basync\s+function\s+bootstrap\s*\(|\bbootstrap\s*\(\s*\)"), ("@nestjs/core", r"@nestjs/core")), 0.55, 0.15, True),
    Model(
        "React", r"(^|/)(main|index|App)\.(tsx|jsx)\z",
        (("ReactDOM.createRoot()", r"ReactDOM\s*\.\s*createRoot\s*\("), ("createRoot()", r"\bcreateRoot\s*\("), ("ReactDOM.render(", r"ReactDOM\s*\.\s*render\s*\("), ('from "react"', r"from\s+[\"']react[\"']")),
        0.6, 0.12, True, r"(^|/)(app|pages)/",
    ),
    Model(
        "Node", r"(^|/)((server|app)\.(ts|js|mjs)|index\.(ts|js))\z",
        (("express()", r"\bexpress\s*\("), ("fastify()", r"\bfastify\s*\("), ("createServer(", r"\bcreateServer\s*\("), ("listen(", r"\.listen\s*\("), ("koa(", r"\bnew\s+Koa\s*\(|\bkoa\s*\(")), 0.5, 0.15, True,
    ),
    Model("Django", r"(^|/)manage\.py\z", (("django", r"(?i)\bdjango\b"), ("execute_from_command_line", r"\bexecute_from_command_line\b")), 0.9, 0.04, False),
    Model(
        "Python", r"(^|/)(main|app|wsgi|asgi)\.py\z",
        (("FastAPI()", r"\bFastAPI\s*\("), ("Flask(", r"\bFlask\s*\("), ("uvicorn", r"\buvicorn\b"), ("if __name__", r"if\s+__name__\s*==\s*[\"']__main__[\"']")), 0.55, 0.15, True,
    ),
    Model(
        "Java", r"(?i)(Application|Main)\.java\z",
        (("@SpringBootApplication", r"@SpringBootApplication\b"), ("public static void main", r"public\s+static\s+void\s+main\s*\("), ("SpringApplication.run", r"\bSpringApplication\s*\.\s*run\s*\(")), 0.55, 0.15, True,
    ),
    Model("Go", r"(^|/)main\.go\z", (("package main", r"(?m)^package\s+main\b"), ("func main()", r"\bfunc\s+main\s*\(\s*\)")), 0.65, 0.15, True),
    Model("Rust", r"(^|/)main\.rs\z", (("fn main()", r"\bfn\s+main\s*\(\s*\)"),), 0.7, 0.2, True),
)


def _match(m: Model) -> Column:
    """A struct for the model if a file fits it, else null. Signals are looked for only where the path fits."""
    fits = F.col("path").rlike(m.path) & ~F.col("path").rlike(m.not_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = F.filter(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in m.signals]), lambda x: x.isNotNull())
    n = F.size(hits)
    told = F.struct(
        F.lit(m.framework).alias("framework"), entrypoint_confidence(F.lit(m.base), n, F.lit(m.boost)).alias("confidence"), F.array_sort(F.concat(F.array(F.concat(F.lit("path:"), F.col("path"))), hits)).alias("evidence")
    )
    return F.when(fits & ((n > 0) | F.lit(not m.needs_signal)), told)


def discover(files: DataFrame, minimum: float = 0.55) -> DataFrame:
    """repo, path, framework, confidence, evidence: a file may be the entrypoint of several frameworks. ``files``: repo, path, text."""
    found = F.filter(F.array(*[_match(m) for m in MODELS]), lambda x: x.isNotNull())
    return files.select("repo", "path", F.inline(found)).where(F.col("confidence") >= minimum)
