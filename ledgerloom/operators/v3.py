"""V3: semantic records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import refs, vocab
from ledgerloom.functions.docs import blank, equals, listed, one_of
from ledgerloom.operators.base import diag, lookup, named

CHANGE_KEYS = ("op", "target", "path", "value_ref", "cell_id")


def verified(record: DataFrame) -> DataFrame:
    """record(ak, record_id, record_type, result, target, status)"""
    passed = record.where("record_type = 'sol:record/verification' AND result = 'passed'").where(F.coalesce("status.staleness", F.lit("current")) == "current")
    claimed = record.where("status.verification = 'verified'").withColumn("ref", named("record", "record_id"))
    bare = claimed.join(passed.select("ak", F.col("target").alias("ref")), ["ak", "ref"], "left_anti")
    return diag(bare, "V3-01", "unverified_claim", F.col("ref"), "the record counts as verified without a current passed verification")


def transitions(record: DataFrame) -> DataFrame:
    """record(ak, id, filled, record_id, record_type, result, target, status, status_transition)"""
    forged = record.where("status_transition.`from` = 'stale' AND status_transition.to = 'current'").where(~one_of(F.col("status_transition.via"), ("successful_rerun", "passed_verification")))
    failed = record.where("record_type = 'sol:record/verification' AND result = 'failed'").where(~blank(F.col("target")))
    still = lookup(record.where("status.verification = 'verified'"))
    kept = failed.select("ak", "target", refs.bare_id(F.col("target"), "record").alias("key")).join(still, ["ak", "key"], "left_semi")
    return diag(forged, "V3-02", "illegal_status_transition", named("record", "record_id"), "from stale to current without a rerun or a verification").unionByName(diag(kept, "V3-02", "illegal_status_transition", F.col("target"), "a verification failed and its target still counts as verified"))


def reproducibility(manifest: DataFrame, record: DataFrame) -> DataFrame:
    """manifest(ak, reproducibility_status), record(ak, record_type, method, result)"""
    passed = record.where("record_type = 'sol:record/verification' AND method = 'sol:verify/reexecution' AND result = 'passed'")
    bare = manifest.where("reproducibility_status = 'reproducible'").join(passed, "ak", "left_anti")
    return diag(bare, "V3-03", "broken_provenance", "manifest.reproducibility_status", "called reproducible without a passed reexecution")


def concordance(record: DataFrame, manifest: DataFrame) -> DataFrame:
    """record(ak, record_id, record_type, method, concordance, has_concordance), manifest(ak, execution)"""
    again = record.where("record_type = 'sol:record/verification' AND method = 'sol:verify/reexecution'")
    target = named("record", "record_id", "None")
    none = diag(again.where(~F.col("has_concordance")), "V3-04", "broken_provenance", target, "a reexecution has no concordance model", "a")
    strict = again.where("has_concordance").join(manifest.where("execution.deterministic").select("ak"), "ak", "left_semi")
    loose = strict.where(~one_of(F.col("concordance.type"), ("exact", "tolerance")))
    return none.unionByName(diag(loose, "V3-04", "broken_provenance", target, "the concordance does not suit a deterministic artifact", "b"))


def _rule_05(rows: DataFrame, part: str | Column, message: str | Column) -> DataFrame:
    return diag(rows, "V3-05", "invalid_proposal_application", named("commit", "commit_id"), message, part)


def applications(commit: DataFrame, record: DataFrame) -> DataFrame:
    """commit(ak, id, commit_id, changes, applied_proposals), record(ak, id, filled, changes)"""
    return unaccepted(commit, record).unionByName(lacking(commit, record, commit))


def _applied(commit: DataFrame) -> DataFrame:
    ops = commit.select("ak", "id", "commit_id", "applied_proposals", F.explode("changes").alias("c")).where("c.op = 'apply_proposal'").withColumn("ref", F.col("c.proposal")).drop("c")
    return ops.withColumn("key", refs.bare_id(F.nullif("ref", F.lit("")), "record"))


def unaccepted(commit: DataFrame, record: DataFrame) -> DataFrame:
    """commit(ak, id, commit_id, changes, applied_proposals), record(ak, id, filled)

    Many commits may name one review, so what reviews are missing is found over the distinct names.
    """
    both = _applied(commit).join(lookup(record).withColumn("found", F.lit(True)), ["ak", "key"], "left")
    both = both.withColumn("app", F.get(F.filter("applied_proposals", lambda a: a["proposal"].eqNullSafe(F.col("ref"))), F.lit(0)))
    no_review = F.coalesce(F.size("app.accepted_by"), F.lit(0)) <= 0
    bare = both.withColumn("part", F.when(F.col("found").isNull(), F.lit("a")).when(no_review, F.lit("b"))).where("part IS NOT NULL")
    message = F.when(F.col("part") == "a", F.lit("an applied proposal does not exist")).otherwise(F.lit("an application is linked to no accepting review"))
    each = F.explode("a.accepted_by").alias("r")
    asked = commit.select("ak", F.explode("applied_proposals").alias("a")).select("ak", each).distinct().withColumn("key", refs.bare_id(F.col("r"), "record"))
    absent = asked.join(lookup(record), ["ak", "key"], "left_anti").select(F.col("ak").alias("ak2"), F.col("r").alias("r2"))
    reviews = both.where("found").where(~no_review).select("ak", "commit_id", F.explode("app.accepted_by").alias("r"))
    gone = reviews.join(absent, (F.col("ak") == F.col("ak2")) & F.col("r").eqNullSafe(F.col("r2")), "left_semi")
    return _rule_05(bare, F.col("part"), message).unionByName(_rule_05(gone, "c", "an accepting review does not exist"))


def lacking(commit: DataFrame, record: DataFrame, changed: DataFrame) -> DataFrame:
    """commit(ak, id, commit_id, changes, applied_proposals), record(ak, id, filled, changes), changed(ak, id, changes) of the commits; the changes of one record or commit may come in several rows."""
    there = _applied(commit).join(lookup(record, proposed="changes"), ["ak", "key"])
    wanted = there.select("ak", "id", "commit_id", F.explode("proposed").alias("p")).select("ak", "id", "commit_id", *(F.col(f"p.{k}").alias(k) for k in CHANGE_KEYS))
    made = changed.select("ak", "id", F.explode("changes").alias("c")).where(~equals(F.col("c.op"), "apply_proposal")).select(F.col("ak").alias("ak2"), F.col("id").alias("id2"), *(F.col(f"c.{k}").alias(f"made_{k}") for k in CHANGE_KEYS))
    same = (F.col("ak") == F.col("ak2")) & (F.col("id") == F.col("id2"))
    for k in CHANGE_KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"made_{k}"))
    return _rule_05(wanted.join(made, same, "left_anti"), "d", "the commit lacks a change of the proposal")


def decisions(record: DataFrame) -> DataFrame:
    """record(ak, id, filled, record_id, record_type, and the five fields of a decision)"""
    decision = record.where("record_type = 'sol:record/decision'")
    lists = ("candidates", "based_on")
    lacks = lambda f: F.coalesce(F.size(f), F.lit(0)) <= 0 if f in lists else blank(F.col(f))
    fields = F.array_compact(F.array(*(F.when(lacks(f), F.lit(f)) for f in vocab.DECISION_FIELDS)))
    target = named("record", "record_id", "None")
    empty = diag(decision.withColumn("f", F.explode(fields)), "V3-06", "schema", target, F.concat(F.lit("a decision lacks its "), "f"))
    based = decision.select("ak", "record_id", F.explode("based_on").alias("ref")).withColumn("key", refs.bare_id(F.col("ref"), "record"))
    gone = based.join(lookup(record), ["ak", "key"], "left_anti")
    return empty.unionByName(diag(gone, "V3-07", "invalid_reference", target, F.concat(F.lit("a decision is based on a record that does not exist: "), "ref")))


def external_evidence(record: DataFrame) -> DataFrame:
    """record(ak, record_id, record_type, external, has_availability)"""
    silent = record.where("record_type = 'sol:record/evidence' AND external").where(~F.col("has_availability"))
    return diag(silent, "V3-08", "broken_provenance", named("record", "record_id", "None"), "external evidence does not tell whether it is available")


def unavailable_evidence(supported: DataFrame) -> DataFrame:
    """v2.supports()"""
    told = equals(F.col("staleness"), "stale") & equals(F.col("verification"), "needs_reverification")
    return diag(supported.where("n_unavailable = n").where(~told), "V3-08", "stale_record", named("record", "record_id", "None"), "none of the claim's evidence is available, and its status does not say so")
