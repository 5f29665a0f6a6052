"""All rules over all artifacts: one distinct, ordered table of diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import v0, v1, v2, v3, v4, v5
from ledgerloom.operators.base import diag, named
from ledgerloom.plans.summary import machine_summaries
from ledgerloom.sources.artifacts import Relations


def _with_manifest(rows: DataFrame, r: Relations) -> DataFrame:
    """Rows of artifacts that have a manifest: without one the rules of V0 end after its first."""
    return rows.join(r.manifest.where("present").select("ak"), "ak", "left_semi")


def _vocabulary(r: Relations) -> DataFrame:
    return v0.status_vocabulary(_with_manifest(r.record, r))


def _broken(r: Relations) -> DataFrame:
    return diag(r.broken, "LOAD", "schema", F.element_at(F.split("path", "/"), -1), "the document is no JSON object")


#: Rule family to its function of the relations.
RULES: dict[str, Callable[[Relations], DataFrame]] = {
    "LOAD": _broken,
    "V0-01/02": lambda r: v0.manifest_keys(r.manifest),
    "V0-03": lambda r: v0.features(r.manifest.where("present")),
    "V0-04": _vocabulary,
    "V0-05/06": lambda r: v0.grammar(_with_manifest(r.ref, r)),
    "V0-06 missing": lambda r: v0.missing_objects(_with_manifest(r.ref, r), r.object),
    "V0-06 names": lambda r: v0.object_names(_with_manifest(r.object, r)),
    "V1-01 cycles": lambda r: v1.commit_cycles(r.commit),
    "V1-01 parents": lambda r: v1.missing_parents(r.commit),
    "V1-02": lambda r: v1.authors(r.commit, r.actor),
    "V1-03": lambda r: v1.anchors(r.cell, r.record),
    "V1-04": lambda r: v1.gates(r.cell, r.record),
    "V1-05": lambda r: v1.named_outputs(r.ref, v1.bindings(r.run)),
    "V1-06/07": lambda r: v1.stored_objects(r.ref, r.object),
    "V2-01": lambda r: v2.execution_prefix(r.run, r.structure),
    "V2-02": lambda r: v2.dependency_order(r.cell, v2.linear_order(r.structure)),
    "V2-03": lambda r: v2.partial_success(r.run, r.record),
    "V2-04": lambda r: v2.uncommitted(r.run),
    "V2-05 direct": lambda r: v2.direct_staleness(r.record, v2.stale_refs(r.run, r.record)),
    "V2-05 aggregate": lambda r: v2.aggregate_staleness(v2.supports(r.record)),
    "V2-06": lambda r: v2.undeclared_reads(r.run, r.cell),
    "V3-01": lambda r: v3.verified(r.record),
    "V3-02": lambda r: v3.transitions(r.record),
    "V3-03": lambda r: v3.reproducibility(r.manifest, r.record),
    "V3-04": lambda r: v3.concordance(r.record, r.manifest),
    "V3-05": lambda r: v3.applications(r.commit, r.record),
    "V3-06/07": lambda r: v3.decisions(r.record),
    "V3-08 external": lambda r: v3.external_evidence(r.record),
    "V3-08 aggregate": lambda r: v3.unavailable_evidence(v2.supports(r.record)),
    "V4-01": lambda r: v4.protected_branches(v4.capabilities(r.commit, r.actor), r.manifest),
    "V4-02": lambda r: v4.self_review(r.commit, r.record, r.manifest),
    "V4-03": lambda r: v4.operations(v4.capabilities(r.commit, r.actor)),
    "V5-01": lambda r: v5.source_commits(r.render),
    "V5-02": lambda r: v5.disclosures(r.render, r.record),
    "V5-03": lambda r: v5.summaries(r.summary, machine_summaries(r)),
}


def distinct(diagnostics: DataFrame) -> DataFrame:
    """One of equal rule, category, target and message within an artifact."""
    return diagnostics.dropDuplicates(["ak", "rule_id", "category", "target", "message"])


def diagnose(r: Relations, rules: list[str] | None = None) -> DataFrame:
    """Distinct diagnostics (ak, rule_id, category, severity, target, message), in no order."""
    return distinct(reduce(DataFrame.unionByName, (RULES[k](r) for k in rules or RULES)))


def ordered(diagnostics: DataFrame) -> DataFrame:
    """In code-point order of artifact, rule, category, target, message; for sinks."""
    return diagnostics.orderBy("ak", "rule_id", "category", "target", "message")
