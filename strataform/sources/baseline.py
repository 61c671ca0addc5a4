"""Baselines, gate options and deltas as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.numbers import SEVERITIES

#: What every finding in a baseline must have as text.
REQUIRED = ["id", "ruleId", "severity", "title", "message"]
DELTA_VERSION = "1.0.0"


class BaselineError(ValueError):
    """A baseline is no JSON object, has no findings array, or an entry that is no finding."""


def load_baselines(texts: DataFrame) -> DataFrame:
    """source, id, rule_id, severity, title, message of earlier reports; ``texts``: source, text (one JSON document each).

    All of them are checked before any is used: one bad document or entry is an error that names its source.
    """
    v = texts.select("source", F.try_parse_json("text").alias("v"))
    listed = v.withColumn("l", F.try_variant_get("v", "$.findings", "array<variant>"))
    bad = listed.where("l is null").select("source").first()
    if bad:
        raise BaselineError(f"{bad[0]}: no JSON object with a findings array")
    each = listed.select("source", F.explode("l").alias("f"))
    typed = each.select("source", *[F.when(F.schema_of_variant(F.try_variant_get("f", f"$.{n}", "variant")) == "STRING", F.try_variant_get("f", f"$.{n}", "string")).alias(n) for n in REQUIRED])
    odd = typed.where(" or ".join(f"{n} is null" for n in REQUIRED)).select("source").first()
    if odd:
        raise BaselineError(f"{odd[0]}: an entry is no finding")
    return typed.withColumnRenamed("ruleId", "rule_id")


def severity_gate(value: str) -> str:
    """critical, warning or info, in any case."""
    name = value.strip().lower()
    if name not in SEVERITIES:
        raise ValueError(f"a severity is one of {', '.join(SEVERITIES)}, not {value!r}")
    return name


def rule_list(value: str) -> list[str]:
    """A comma list without empty parts."""
    return [p for p in (x.strip() for x in value.split(",")) if p]


def delta_documents(delta: DataFrame, scope: list[str]) -> DataFrame:
    """scope, document: the rows of a delta (scope, change, ...) per scope as one JSON text with a version, rows in order."""
    rest = [c for c in delta.columns if c not in scope]
    rows = F.sort_array(F.collect_list(F.struct(*sorted(rest))))
    return delta.groupBy(*scope).agg(F.to_json(F.struct(F.lit(DELTA_VERSION).alias("schemaVersion"), rows.alias("rows"))).alias("document"))


def parse_deltas(documents: DataFrame, spark: SparkSession, row: str) -> DataFrame:
    """The rows of delta documents (scope ..., document) again; ``row`` is their schema. Another version is an error."""
    versions = [r[0] for r in documents.select(F.get_json_object("document", "$.schemaVersion").alias("v")).distinct().limit(2).collect()]
    if any(v != DELTA_VERSION for v in versions):
        raise ValueError(f"delta version {versions}, not {DELTA_VERSION}")
    scope = [c for c in documents.columns if c != "document"]
    return documents.select(*scope, F.explode(F.from_json("document", f"schemaVersion string, rows array<struct<{row}>>")["rows"]).alias("x")).select(*scope, "x.*")
