"""Vocabularies of the artifact format, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format.
FEATURES = ("sol:feature/linear_execution", "sol:feature/internal_object_store", "sol:feature/machine_summary", "sol:feature/signatures", "sol:feature/external_evidence")
LIFECYCLES = ("draft", "active", "superseded", "withdrawn")
PROPOSAL_LIFECYCLES = ("pending_review", "accepted", "rejected", "amended", "superseded", "applied")
STALENESS = ("current", "stale", "unknown")
VERIFICATION = ("unverified", "verified", "failed_verification", "needs_reverification")
RUN_STATUSES = ("success", "partial_success", "failure", "cancelled")
STALE_STALENESS = ("stale", "unknown")
STALE_VERIFICATION = ("needs_reverification", "failed_verification")
CAPABILITIES = {
    "read_only": ("read",),
    "propose_only": ("read", "create_branch", "write_cell", "write_record"),
    "review_required": ("read", "create_branch", "write_cell", "write_record", "execute", "review", "commit"),
    "autonomous_commit": ("read", "create_branch", "write_cell", "write_record", "execute", "commit", "apply_proposal"),
}
NEEDED = {"modify_cell": "write_cell", "update_record_status": "write_record", "apply_proposal": "apply_proposal", "bind_output": "execute"}
DECISION_FIELDS = ("candidates", "selected", "decision_rule", "made_by", "based_on")


def capability_rows(spark: SparkSession) -> DataFrame:
    """(autonomy_level, capabilities), four rows."""
    return spark.createDataFrame([(k, list(v)) for k, v in CAPABILITIES.items()], "autonomy_level string, level_capabilities array<string>")


def needed_rows(spark: SparkSession) -> DataFrame:
    """(op, needed), four rows."""
    return spark.createDataFrame(list(NEEDED.items()), "op string, needed string")


def status_rows(spark: SparkSession) -> DataFrame:
    """(proposal, dim, value): every allowed status value of a dimension, for proposals and for other records."""
    rows = [(p, "lifecycle", v) for p, values in ((False, LIFECYCLES), (True, PROPOSAL_LIFECYCLES)) for v in values]
    rows += [(p, dim, v) for p in (False, True) for dim, values in (("staleness", STALENESS), ("verification", VERIFICATION)) for v in values]
    return spark.createDataFrame(rows, "proposal boolean, dim string, value string")
