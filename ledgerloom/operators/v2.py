"""V2: runs, dependencies, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import refs, vocab
from ledgerloom.functions.docs import equals, listed, one_of, staleish
from ledgerloom.operators.base import diag, lookup, named


def linear_order(structure: DataFrame) -> DataFrame:
    """(ak, pos, cell) of linear structures; of a repeated cell the last position counts."""
    each = structure.where("linear").select("ak", F.posexplode("cells").alias("pos", "cell"))
    return each.groupBy("ak", "cell").agg(F.max("pos").alias("pos"))


def execution_prefix(run: DataFrame, structure: DataFrame) -> DataFrame:
    """run(ak, run_id, status, cells_executed), structure(ak, linear, cells)"""
    order = structure.where("linear AND size(cells) > 0").select("ak", F.col("cells").alias("order"))
    cells = F.transform(listed(F.col("cells_executed")), lambda c: refs.bare_id(c, "cell"))
    known = run.where(one_of(F.col("status"), vocab.RUN_STATUSES)).withColumn("cells", cells).join(order, "ak")
    odd = known.where(F.col("cells") != F.slice("order", F.lit(1), F.size("cells")))
    return diag(odd, "V2-01", "execution_order", named("run", "run_id"), "the executed cells are no prefix of the linear order")


def dependency_order(cell: DataFrame, order: DataFrame) -> DataFrame:
    """cell(ak, cell_id, depends_on), order(ak, cell, pos)"""
    deps = cell.select("ak", F.coalesce("cell_id", F.lit("")).alias("cell_id"), F.explode("depends_on").alias("dep")).withColumn("on", refs.bare_id(F.col("dep"), "cell"))
    mine = order.select("ak", F.col("cell").alias("cell_id"), F.col("pos").alias("at"))
    other = order.select("ak", F.col("cell").alias("on"), F.col("pos").alias("on_at"))
    odd = deps.join(mine, ["ak", "cell_id"]).join(other, ["ak", "on"]).where("on_at >= at")
    return diag(odd, "V2-02", "invalid_dependency", F.concat(F.lit("cell:"), "cell_id"), F.concat(F.lit("a dependency does not come before the cell: "), "dep"))


def partial_success(run: DataFrame, record: DataFrame) -> DataFrame:
    """run(ak, run_id, status, cells_executed, output_bindings), record(ak, record_type, run_id)"""
    return unpaired(run, record).unionByName(overbound(run))


def _partial(run: DataFrame) -> DataFrame:
    return run.where("status = 'partial_success'").withColumn("ref", named("run", "run_id"))


def unpaired(run: DataFrame, record: DataFrame) -> DataFrame:
    """run(ak, run_id, status), record(ak, record_type, run_id)"""
    failed = record.where("record_type = 'sol:record/failure'").select("ak", F.col("run_id").alias("ref"))
    return diag(_partial(run).join(failed, ["ak", "ref"], "left_anti"), "V2-03", "invalid_partial_success", F.col("ref"), "a partial success has no failure record", "a")


def overbound(run: DataFrame) -> DataFrame:
    """run(ak, run_id, status, cells_executed, output_bindings); the bindings of one run may come in several rows."""
    cells = F.transform(listed(F.col("cells_executed")), lambda c: refs.bare_id(c, "cell"))
    bound = _partial(run).select("ak", "ref", cells.alias("cells"), F.explode("output_bindings").alias("b")).withColumn("p", refs.parse_ref(F.col("b.named_output")))
    greedy = bound.where("p.kind = 'named_output'").where(~F.array_contains("cells", F.col("p.ident")))
    return diag(greedy, "V2-03", "invalid_partial_success", F.col("ref"), "a partial success binds an output of a cell that it did not execute", "b")


def uncommitted(run: DataFrame) -> DataFrame:
    """run(ak, run_id, status)"""
    return diag(run.where("status = 'partial_uncommitted'"), "V2-04", "schema", named("run", "run_id"), "an uncommitted partial run is part of the history")


def stale_refs(run: DataFrame, record: DataFrame) -> DataFrame:
    """(ak, ref): outputs and objects of invalidated or stale bindings, and stale records. One hop, no closure."""
    bad = run.select("ak", F.explode("output_bindings").alias("b")).where("b.status IN ('invalidated', 'stale')")
    outputs = bad.select("ak", F.explode(F.array("b.named_output", "b.object_ref")).alias("ref")).where("ref <> ''")
    records = record.where(staleish(F.col("status.staleness"), F.col("status.verification"))).select("ak", named("record", "record_id", "None").alias("ref"))
    return outputs.unionByName(records).distinct()


def direct_staleness(record: DataFrame, stale: DataFrame) -> DataFrame:
    """record(ak, record_id, status, depends_on, supporting_evidence, based_on), stale(ak, ref)"""
    deps = F.concat(*(listed(F.col(c)) for c in ("depends_on", "supporting_evidence", "based_on")))
    quiet = record.where(~equals(F.col("status.staleness"), "stale") & ~one_of(F.col("status.verification"), vocab.STALE_VERIFICATION))
    hit = quiet.select("ak", "record_id", F.explode(deps).alias("ref")).join(stale, ["ak", "ref"], "left_semi")
    return diag(hit, "V2-05", "stale_record", named("record", "record_id"), "something that the record depends on is stale, and its status does not say so")


def supports(record: DataFrame) -> DataFrame:
    """Claims with at least one support: (ak, id, record_id, staleness, verification, n, n_stale, n_unavailable).

    A support that is not found counts as stale.
    """
    claims = record.where("record_type = 'sol:record/claim'").select("ak", "id", "record_id", "status.staleness", "status.verification", F.explode("supporting_evidence").alias("s"))
    found = lookup(record, e_staleness="status.staleness", e_verification="status.verification", availability="external_ref.availability").withColumn("found", F.lit(True))
    each = claims.withColumn("key", refs.bare_id(F.col("s"), "record")).join(found, ["ak", "key"], "left")
    stale = F.col("found").isNull() | staleish(F.col("e_staleness"), F.col("e_verification"))
    gone = stale | equals(F.col("availability"), "unavailable")
    count = lambda c: F.sum(c.cast("int"))
    return each.groupBy("ak", "id", "record_id", "staleness", "verification").agg(F.count(F.lit(1)).alias("n"), count(stale).alias("n_stale"), count(gone).alias("n_unavailable"))


def aggregate_staleness(supported: DataFrame) -> DataFrame:
    """supports()"""
    waits = equals(F.col("verification"), "needs_reverification")
    told = equals(F.col("staleness"), "stale") & waits
    all_ = diag(supported.where("n_stale = n").where(~told), "V2-05", "stale_record", named("record", "record_id"), "all of the claim's evidence is stale or missing, and its status does not say so")
    some = diag(supported.where("n_stale > 0 AND n_stale < n").where(~waits), "V2-05", "stale_record", named("record", "record_id"), "some of the claim's evidence is stale or missing, and it does not wait for verification")
    return all_.unionByName(some)


def undeclared_reads(run: DataFrame, cell: DataFrame) -> DataFrame:
    """run(ak, dependency_hints), cell(ak, id, depends_on)"""
    hints = run.select("ak", F.explode("dependency_hints").alias("h")).select("ak", refs.bare_id(F.coalesce("h.cell_id", F.lit("")), "cell").alias("cell"), F.explode("h.undeclared_reads").alias("read"))
    declared = cell.select("ak", F.col("id").alias("cell"), F.explode("depends_on").alias("read"))
    return diag(hints.join(declared, ["ak", "cell", "read"], "left_anti"), "V2-06", "undeclared_dependency", F.concat(F.lit("cell:"), "cell"), F.concat(F.lit("a trusted hint tells of a read that is not declared: "), "read"))
