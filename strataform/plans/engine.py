"""The closed set of typed queries over one directory of tables: validated parameters in, an envelope with rows and how sure they are out."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions import numbers
from strataform.plans import reference as R


class QueryError(ValueError):
    """The query is not one of the set, or its parameters are not allowed."""


class QueryNotFound(LookupError):
    """Nothing matches."""


@dataclass(frozen=True)
class Envelope:
    query: str
    rows: DataFrame
    count: int
    confidence: float


def required(name: str, value: object) -> str:
    """A parameter as trimmed text; empty ones and control characters are refused."""
    text = value.strip() if isinstance(value, str) else ""
    if not text or re.search(r"[\x00-\x1f\x7f]", text):
        raise QueryError(f"{name} must be text")
    return text


_EXPORTED = {
    "ListDomains": ("domain", dict(name="name", confidence="confidence")),
    "ListEntrypoints": ("entrypoint", dict(framework="framework", file="file", confidence="confidence")),
    "ListArchitectures": ("architecture", dict(pattern="pattern", confidence="confidence")),
    "ListComponents": ("component", dict(name="name", path="path", owner="owner")),
}
_TABLES: dict[str, Callable] = {
    "ListDependencies": R.dependencies,
    "ListRelationships": R.relationships,
    "ListClaims": R.list_claims,
    "ListEvidence": R.stored_evidence,
    "ListContradictions": R.contradictions,
    "ListInvalidations": R.invalidations,
    "ListOwnership": R.ownership_resolution,
    "ListRisks": R.risks,
    "ListChanges": R.contradiction_delta,
    "Statistics": R.statistics,
    "ProjectSummary": R.brain_summary,
    "RepositorySummary": R.statistics,
}
_NAMED = {
    "FindEntrypoint": ("ListEntrypoints", "file"),
    "FindArchitecture": ("ListArchitectures", "pattern"),
}
QUERY_TYPES = [*_EXPORTED, *_TABLES, *_NAMED, "FindDomain", "FindComponent", "FindDependency", "FindRelationship", "FindEvidence", "Impact", "BlastRadius", "Trace", "ExplainClaim"]


class QueryEngine:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def run(self, query: str, **parameters: str) -> Envelope:
        """Query names compare without case, blanks, hyphens and underscores."""
        plain = lambda s: re.sub(r"[\s_-]", "", s).lower()
        name = next((q for q in QUERY_TYPES if plain(q) == plain(required("query", query))), None)
        if name is None:
            raise QueryError(f"unknown query: {query}")
        rows = self._rows(name, parameters).persist()
        try:
            n = rows.count()
            sure = rows.agg(numbers.mean_confidence(F.col("confidence").cast("double"))).first()[0] if "confidence" in rows.columns else 1.0
        finally:
            rows.unpersist()
        if name.startswith(("Find", "Explain")) and not n:
            raise QueryNotFound(f"{name}: nothing matches {parameters}")
        return Envelope(name, rows, n, sure)

    def _rows(self, name: str, p: dict) -> DataFrame:
        at = (self.spark, self.sf_dir)
        if name in _EXPORTED:
            entity, fields = _EXPORTED[name]
            return R.exported(*at, entity, **fields)
        if name in _TABLES:
            return _TABLES[name](*at)
        if name in _NAMED:
            listed, column = _NAMED[name]
            return self._rows(listed, {}).where(F.lower(column) == required(column, p.get(column)).lower())
        if name == "ExplainClaim":
            return R.claim_explanations(*at).where(F.col("claim_id") == required("claim_id", p.get("claim_id")).lower())
        target = required("target", p.get("target") or p.get("name") or p.get("needle"))
        if name in ("FindDependency", "FindRelationship"):
            f = R.find_dependency if name == "FindDependency" else R.find_relationship
            return f(*at, target, required("kind", p.get("kind")))
        if name == "Trace":
            modes = {
                "dependents": R.trace_dependents, "dependencies": R.trace_dependencies, "blast-radius": R.blast_radius,
                "entrypoint-downstream": R.entrypoint_downstream, "domain-modules": R.domain_modules,
            }
            f = modes.get(p.get("mode", "blast-radius"))
            if f is None:
                raise QueryError(f"unknown mode: {p['mode']}")
            return f(*at, target)
        return {"FindDomain": R.find_domain, "FindComponent": R.find_component, "FindEvidence": R.evidence_search, "Impact": R.impact, "BlastRadius": R.blast_radius}[name](*at, target)
