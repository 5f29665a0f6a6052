"""V0: container and vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import vocab
from ledgerloom.functions.docs import blank
from ledgerloom.operators.base import diag, named


def manifest_keys(manifest: DataFrame) -> DataFrame:
    """manifest(ak, present, sol_version, artifact_id)"""
    there = manifest.where("present")
    none = diag(manifest.where(~F.col("present")), "V0-01", "schema", "manifest", "there is no manifest, or it is empty")
    version = diag(there.where(blank(F.col("sol_version"))), "V0-01", "schema", "manifest.sol_version", "the manifest names no format version")
    ident = diag(there.where(blank(F.col("artifact_id"))), "V0-02", "schema", "manifest.artifact_id", "the manifest names no artifact id")
    return none.unionByName(version).unionByName(ident)


def features(manifest: DataFrame) -> DataFrame:
    """manifest(ak, required_features)"""
    each = manifest.select("ak", F.explode("required_features").alias("f")).where(~F.col("f").isin(*vocab.FEATURES))
    return diag(each, "V0-03", "unsupported", F.concat(F.lit("manifest.required_features:"), "f"), F.concat(F.lit("required feature is not supported: "), "f"))


def status_vocabulary(record: DataFrame) -> DataFrame:
    """record(ak, record_id, record_type, status{lifecycle, staleness, verification})"""
    dims = ("lifecycle", "staleness", "verification")
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"status.{d}").alias("value")) for d in dims))).alias("s")
    proposal = F.coalesce(F.col("record_type") == "sol:record/proposal", F.lit(False)).alias("proposal")
    rows = record.select("ak", "record_id", proposal, each).select("ak", "record_id", "proposal", "s.*").where(~blank(F.col("value")))
    known = F.broadcast(vocab.status_rows(record.sparkSession))  # a fixed vocabulary
    odd = rows.join(known, ["proposal", "dim", "value"], "left_anti")
    return diag(odd, "V0-04", "illegal_status_transition", F.concat(named("record", "record_id"), F.lit(".status."), "dim"), F.concat_ws(" ", F.lit("no such"), "dim", F.lit("value:"), "value"))


def grammar(ref: DataFrame) -> DataFrame:
    """ref(ak, ref, kind)"""
    odd = ref.where("kind IS NULL")
    stored = odd.where(F.col("ref").startswith("object:") | F.col("ref").startswith("digest:"))
    return diag(odd, "V0-05", "invalid_reference", F.col("ref"), "the reference fits no form of the grammar").unionByName(diag(stored, "V0-06", "invalid_reference", F.col("ref"), "an object or digest reference is malformed"))


def missing_objects(ref: DataFrame, object_: DataFrame, rule_id: str = "V0-06", message: str = "the artifact stores no such object") -> DataFrame:
    """ref(ak, ref, kind, ident), object(ak, digest, reachable)"""
    stored = object_.where("reachable").select("ak", F.col("digest").alias("ident"))
    return diag(ref.where("kind = 'object'").join(stored, ["ak", "ident"], "left_anti"), rule_id, "missing_object", F.col("ref"), message)


def object_names(object_: DataFrame) -> DataFrame:
    """object(ak, digest)"""
    odd = object_.where(~F.col("digest").rlike(r"^[a-f0-9]{64}\n?\z"))
    return diag(odd, "V0-06", "invalid_reference", F.concat(F.lit("object:sha256:"), "digest"), "a stored object's name is no digest")
