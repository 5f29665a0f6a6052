"""V4: who may do what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import refs, vocab
from ledgerloom.functions.docs import blank, listed
from ledgerloom.operators.base import diag, lookup, named


def capabilities(commit: DataFrame, actor: DataFrame) -> DataFrame:
    """``commit`` with ``caps`` of its author: the actor's own, else its level's, else read; none without an author."""
    levels = F.broadcast(vocab.capability_rows(commit.sparkSession))  # a fixed vocabulary
    own = actor.join(levels, "autonomy_level", "left").select("ak", F.col("id").alias("author"), F.when(F.size("capabilities") > 0, F.col("capabilities")).otherwise(F.col("level_capabilities")).alias("own"))
    none = F.array().cast("array<string>")
    return commit.join(own, ["ak", "author"], "left").withColumn("caps", F.when(blank(F.col("author")), none).otherwise(F.coalesce("own", F.array(F.lit("read"))))).drop("own")


def protected_branches(capable: DataFrame, manifest: DataFrame) -> DataFrame:
    """capabilities(), manifest(ak, authorization{protected_branches}): of entries for one branch the last counts.

    Committers are rows that commits are joined with, and not lists that are searched for each commit.
    """
    entries = F.col("authorization.protected_branches")
    names = manifest.select("ak", F.posexplode(entries["branch"]).alias("pos", "branch")).groupBy("ak", "branch").agg(F.max("pos").alias("pos"))
    needed = manifest.select("ak", F.posexplode(entries["required_capabilities"]).alias("pos", "required"))
    policy = names.join(needed, ["ak", "pos"])
    allowed = manifest.select("ak", F.posexplode(entries["allowed_committers"]).alias("pos", "authors")).select("ak", "pos", F.explode("authors").alias("author"))
    both = capable.join(policy, (capable["ak"] == policy["ak"]) & capable["branch"].eqNullSafe(policy["branch"])).drop(policy["ak"]).drop(policy["branch"])
    lacking = both.where(F.size(F.array_except(listed(F.col("required")), F.col("caps"))) > 0)
    return diag(lacking.join(allowed, ["ak", "pos", "author"], "left_anti"), "V4-01", "unauthorized_action", named("commit", "commit_id"), "the commit breaks its branch's policy")


def self_review(commit: DataFrame, record: DataFrame, manifest: DataFrame) -> DataFrame:
    """commit(ak, id, commit_id, applied_proposals), record(ak, id, filled, created_by, reviewed_by), manifest(ak, authorization)"""
    apps = commit.select("ak", "id", "commit_id", F.posexplode("applied_proposals").alias("pos", "app"))
    apps = apps.withColumn("key", refs.bare_id(F.coalesce("app.proposal", F.lit("")), "record")).join(lookup(record, proposer="created_by"), ["ak", "key"]).drop("key")
    reviews = apps.select("ak", "id", "commit_id", "pos", "proposer", F.explode("app.accepted_by").alias("r")).withColumn("key", refs.bare_id(F.col("r"), "record"))
    found = reviews.join(lookup(record, reviewer="reviewed_by"), ["ak", "key"])
    alone = found.groupBy("ak", "id", "commit_id", "pos").agg(F.every(F.col("reviewer").eqNullSafe(F.col("proposer"))).alias("alone")).where("alone")
    permitted = manifest.where("authorization.permit_self_application").select("ak")
    return diag(alone.join(permitted, "ak", "left_anti"), "V4-02", "unauthorized_action", named("commit", "commit_id"), "the proposer alone accepted its own proposal")


def operations(capable: DataFrame) -> DataFrame:
    """capabilities() of commit(ak, commit_id, author, changes)"""
    needed = F.broadcast(vocab.needed_rows(capable.sparkSession))  # a fixed vocabulary
    ops = capable.select("ak", "commit_id", "caps", F.explode("changes").alias("c")).select("ak", "commit_id", "caps", "c.op").join(needed, "op")
    short = ops.where(~F.array_contains("caps", F.col("needed")))
    some = capable.where("size(changes) > 0").where(~F.array_contains("caps", F.lit("commit")))
    target = named("commit", "commit_id")
    return diag(short, "V4-03", "unauthorized_action", target, F.concat_ws(" ", F.lit("the actor has no capability"), "needed", F.lit("for"), "op"), "a").unionByName(diag(some, "V4-03", "unauthorized_action", target, "the actor may not commit", "b"))
