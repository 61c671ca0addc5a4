"""Numbers: confidences at two decimals and the formulas that make them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column, digits: int = 2) -> Column:
    """Halves go up, on the double as it stands: floor(x * 10^d + 0.5) / 10^d. Spark's round and this differ on 1.005 or 0.285."""
    p = float(10**digits)
    return F.floor(x * p + 0.5) / p


def clamp(x: Column, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(high))


def confidence(x: Column, high: float = 1.0) -> Column:
    """Clamped to [0, high], at two decimals."""
    return js_round(clamp(x, high))


def exact(x: Column) -> Column:
    """A confidence as a decimal, so that sums don't depend on the order of rows."""
    return x.cast("decimal(12,8)")


def mean_confidence(x: Column) -> Column:
    """Mean at two decimals over the non-null values, 0 without any."""
    total = F.sum(exact(x)).cast("double")
    return F.coalesce(js_round(total / F.nullif(F.count(x), F.lit(0))), F.lit(0.0))


def rank_of(c: Column, order: list[str]) -> Column:
    """Place of a value in a list from least (1) to greatest; 0 for others."""
    return reduce(lambda acc, iv: acc.when(c == iv[1], iv[0] + 1), enumerate(order), F.when(F.lit(False), 0)).otherwise(0)


#: Confidence of a dependency by relation type.
DEPENDENCY_CONFIDENCE = {
    "import": 0.97,
    "export": 0.96,
    "require": 0.95,
    "package": 0.9,
    "service": 0.88,
    "repository": 0.88,
    "module": 0.85,
    "route": 0.8,
    "dynamic-import": 0.75,
}

#: Ordinals of strengths and severities, from least to greatest.
STRENGTHS = ["weak", "medium", "strong"]
SEVERITIES = ["info", "warning", "critical"]
RISK_LEVELS = ["low", "medium", "high"]


def entrypoint_confidence(path: Column, hits: Column, boost: Column) -> Column:
    return confidence(path + hits * boost, 0.99)


def relationship_confidence(base: Column, strength: Column, injected: Column, n_evidence: Column) -> Column:
    bonus = F.when(strength == "strong", 0.03).when(strength == "weak", -0.05).otherwise(0.0)
    return confidence(base + bonus + F.when(injected, 0.02).otherwise(0.0) + F.least(F.greatest(n_evidence - 1, F.lit(0)), F.lit(3)) * 0.005, 0.99)


def pattern_confidence(support: Column, conflict: Column, n_rules: Column) -> Column:
    """0 without support or rules; never more than 0.95."""
    raw = support / (support + conflict * 1.25 + 0.35) + F.least(n_rules, F.lit(4)) * 0.03
    return F.when((n_rules <= 0) | (support <= 0), 0.0).otherwise(confidence(raw, 0.95))


def domain_confidence(n_evidence: Column, hits: Column) -> Column:
    raw = F.lit(0.45) + F.least(n_evidence, F.lit(8)) * 0.06 + F.least(hits / F.greatest(n_evidence, F.lit(1)), F.lit(3.0)) * 0.05
    return F.when(n_evidence <= 0, 0.0).otherwise(confidence(raw))
