"""Claims without evidence are explained too, and the contradictions that name a claim are told."""

from __future__ import annotations

from strataform.plans import reference
from strataform.plans.engine import QueryEngine
from tests.conftest import rows
from tests.test_whole_jobs import tables

CLAIMS = "project_id string, snapshot_id string, claim_id string, subject string, predicate string, claim_object string, evidence_ids array<string>, confidence double, status string, superseded_by string, loaded_at timestamp"


def test_claims_without_evidence_are_explained(spark, tmp_path):
    asked = {"a": ["E1 ", "e2"], "b": None, "c": [], "d": [" ", None]}
    sf = tables(
        spark,
        tmp_path,
        brain_claims=([("p", "s", c, "x", "y", "z", e, 0.9, "ACTIVE", None, None) for c, e in asked.items()], CLAIMS),
        brain_evidence=([("p", "s", "e1", "f.ts")], "project_id string, snapshot_id string, evidence_id string, locator string"),
        brain_contradictions=([("p", "s", k, ["B", "a"]) for k in ("k2", "k1")], "project_id string, snapshot_id string, contradiction_id string, claim_ids array<string>"),
    )
    got = reference.claim_explanations(spark, sf).select("claim_id", "n_asked", "n_found", "locators", "contradictions")
    assert rows(got) == [("a", 2, 1, "f.ts", "k1|k2"), ("b", 0, 0, "", "k1|k2"), ("c", 0, 0, "", ""), ("d", 0, 0, "", "")]
    assert QueryEngine(spark, sf).run("ExplainClaim", claim_id="B").count == 1
