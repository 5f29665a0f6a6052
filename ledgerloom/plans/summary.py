"""The machine summary of each artifact, as canonical JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.docs import blank
from ledgerloom.sources.artifacts import Relations


def _value(key: str) -> Column:
    """A key's value as JSON text; null where the key is missing."""
    return F.coalesce(F.to_json(F.variant_get("body", f"$.{key}", "variant")), F.lit("null"))


def _object(**parts: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items())), F.lit("}"))


def _quoted(c: Column) -> Column:
    """A string as JSON."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1))


def _listed(rows: DataFrame, name: str, order: str, text: Column) -> DataFrame:
    """(ak, name): a JSON list of an artifact's ``text``, in order."""
    each = rows.select("ak", F.struct(F.coalesce(F.col(order), F.lit("")).alias("o"), text.alias("t")).alias("x"))
    in_order = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])
    return each.groupBy("ak").agg(F.concat(F.lit("["), F.concat_ws(",", in_order), F.lit("]")).alias(name))


def machine_summaries(r: Relations) -> DataFrame:
    """(ak, summary). An artifact's entities meet in one row, as the summary is one document."""
    status = F.coalesce(F.to_json(F.variant_get("body", "$.status", "variant")), F.lit("{}"))
    parts = [
        _listed(r.cell, "cells", "cell_id", _object(cell_id=_value("cell_id"), cell_type=_value("cell_type"), summary=_value("summary"))),
        _listed(r.actor, "actors", "id", _quoted(F.col("id"))),
        _listed(r.record, "records", "record_id", _object(record_id=_value("record_id"), record_type=_value("record_type"), summary=_value("summary"), status=status)),
        _listed(r.run, "runs", "run_id", _object(run_id=_value("run_id"), status=_value("status"), source_commit=_value("source_commit"), result_commit=_value("result_commit"))),
        r.structure.select("ak", F.to_json("body").alias("execution_structure")),
        r.commit.groupBy("ak").agg(F.max("id").alias("last_commit")),
    ]
    all_ = r.manifest
    for p in parts:
        all_ = all_.join(p, "ak", "left")
    none = F.lit("[]")
    at = F.when(blank(F.col("current_commit")), F.col("last_commit")).otherwise(F.col("current_commit"))
    text = _object(
        render_id=F.lit('"machine_summary"'), target=F.lit('"machine_summary"'), source_commit=_quoted(at), artifact_id=_quoted(F.col("artifact_id")), sol_version=_quoted(F.col("sol_version")),
        execution_structure=F.coalesce("execution_structure", F.lit("{}")), cells=F.coalesce("cells", none), actors=F.coalesce("actors", none), records=F.coalesce("records", none), runs=F.coalesce("runs", none),
    )
    return all_.select("ak", F.to_json(F.parse_json(text)).alias("summary"))
