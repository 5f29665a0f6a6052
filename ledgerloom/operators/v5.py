"""V5: renders tell what they show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import refs
from ledgerloom.functions.docs import blank, listed, staleish
from ledgerloom.operators.base import diag, lookup, named


def source_commits(render: DataFrame) -> DataFrame:
    """render(ak, render_id, source_commit)"""
    return diag(render.where(blank(F.col("source_commit"))), "V5-01", "schema", named("render", "render_id"), "a render names no source commit")


def disclosures(render: DataFrame, record: DataFrame) -> DataFrame:
    """render(ak, render_id, includes_records, stale_disclosures), record(ak, id, filled, status)"""
    shown = render.select("ak", "render_id", listed(F.col("stale_disclosures")).alias("told"), F.explode("includes_records").alias("ref"))
    hidden = shown.where(~F.array_contains("told", F.col("ref"))).withColumn("key", refs.bare_id(F.col("ref"), "record"))
    stale = lookup(record.where(staleish(F.col("status.staleness"), F.col("status.verification"))))
    return diag(hidden.join(stale, ["ak", "key"], "left_semi"), "V5-02", "dishonest_render", named("render", "render_id"), F.concat(F.lit("a render shows a stale record and does not say so: "), "ref"))


def summaries(on_disk: DataFrame, made: DataFrame) -> DataFrame:
    """on_disk(ak, body), made(ak, summary): canonical texts are compared; no summary is no fault."""
    both = on_disk.join(made, "ak").where(F.to_json("body") != F.col("summary"))
    return diag(both, "V5-03", "dishonest_render", "render:machine_summary", "the machine summary is not what the artifact gives")
