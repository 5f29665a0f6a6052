"""V1: references resolve."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import refs
from ledgerloom.functions.docs import listed
from ledgerloom.operators.base import diag, named
from ledgerloom.operators.v0 import missing_objects


def missing_parents(commit: DataFrame) -> DataFrame:
    """commit(ak, id, parents)"""
    edges = commit.select("ak", "id", F.explode("parents").alias("parent")).withColumn("to", refs.bare_id(F.col("parent"), "commit"))
    gone = edges.join(commit.select("ak", F.col("id").alias("to")), ["ak", "to"], "left_anti")
    return diag(gone, "V1-01", "invalid_reference", named("commit", "id"), F.concat(F.lit("no such parent: "), "parent"))


def _reentered(parents: dict[str, list[str]]) -> Iterator[str]:
    """Commits at which a depth-first walk, in the order of the dict, meets its own path."""
    done: set[str] = set()
    for start in parents:
        if start in done:
            continue
        path, stack = {start}, [(start, iter(parents[start]))]
        while stack:
            at, rest = stack[-1]
            for to in rest:
                if to in path:
                    yield to
                elif to in parents and to not in done:
                    path.add(to)
                    stack.append((to, iter(parents[to])))
                    break
            else:
                stack.pop()
                path.discard(at)
                done.add(at)


def _cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (ak, id, to) that come by artifact, each in the order of the walk, the commits that it meets again."""
    at, parents, found = None, {}, []
    for batch in batches:
        for ak, id_, to in zip(*(c.to_pylist() for c in batch.columns)):
            if ak != at:
                found += ((at, c) for c in dict.fromkeys(_reentered(parents)))
                at, parents = ak, {}
            parents[id_] = to
        if found:
            yield _rows(found)
            found = []
    yield _rows([(at, c) for c in dict.fromkeys(_reentered(parents))])


def _rows(found: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.string()) for c in (zip(*found) if found else ((), ()))], ["ak", "id"])


def commit_cycles(commit: DataFrame) -> DataFrame:
    """commit(ak, id, place, parents)

    The reported commit depends on the order of a depth-first walk, which no join expresses, so the
    commits of an artifact, ids only, meet in Python: one pass over sorted rows, which costs by the
    commit and not by the artifact, and holds one artifact at a time.
    """
    thin = commit.select("ak", "id", "place", F.transform(listed(F.col("parents")), lambda p: refs.bare_id(p, "commit")).alias("to"))
    thin = thin.repartition("ak").sortWithinPartitions("ak", F.asc_nulls_last("place")).select("ak", "id", "to")
    return diag(thin.mapInArrow(_cycles, "ak string, id string"), "V1-01", "commit_cycle", named("commit", "id"), "the commit is its own ancestor")


def authors(commit: DataFrame, actor: DataFrame) -> DataFrame:
    """commit(ak, commit_id, author), actor(ak, id)"""
    known = actor.select("ak", F.col("id").alias("author"))
    return diag(commit.join(known, ["ak", "author"], "left_anti").unionByName(commit.where("author = ''").join(known, ["ak", "author"], "left_semi")), "V1-02", "invalid_actor", named("commit", "commit_id"), "the commit's author is no actor of the artifact")


def anchors(cell: DataFrame, record: DataFrame) -> DataFrame:
    """cell(ak, cell_id, cell_type, anchors_record, duplicates), record(ak, id)"""
    anchor = cell.where("cell_type = 'sol:cell/anchor'").withColumn("p", refs.parse_ref(F.col("anchors_record")))
    target = named("cell", "cell_id")
    is_record = F.coalesce(F.col("p.kind") == "record", F.lit(False))
    vague = diag(anchor.where(~is_record), "V1-03", "invalid_reference", target, "an anchor must name one record", "a")
    known = record.select("ak", F.col("id").alias("to"))
    gone = anchor.where(is_record).withColumn("to", F.col("p.ident")).join(known, ["ak", "to"], "left_anti")
    copied = diag(anchor.where("duplicates"), "V1-03", "schema", target, "an anchor repeats what its record holds", "c")
    return vague.unionByName(diag(gone, "V1-03", "invalid_reference", target, "an anchor's record does not exist", "b")).unionByName(copied)


def gates(cell: DataFrame, record: DataFrame) -> DataFrame:
    """cell(ak, cell_id, cell_type, decision_ref), record(ak, id, record_type, filled)"""
    gate = cell.where("cell_type = 'sol:cell/gate'").withColumn("p", refs.parse_ref(F.col("decision_ref")))
    gate = gate.withColumn("to", F.when(F.col("p.kind") == "record", F.col("p.ident")))
    known = record.select("ak", F.col("id").alias("to"), F.col("record_type").alias("found_type"), F.lit(True).alias("found"), "filled")
    both = gate.join(known, ["ak", "to"], "left")
    none = diag(both.where("found IS NULL"), "V1-04", "invalid_reference", named("cell", "cell_id"), "a gate must name an existing decision record", "a")
    other = both.where("found AND filled").where(F.coalesce(F.col("found_type") != "sol:record/decision", F.lit(True)))
    return none.unionByName(diag(other, "V1-04", "invalid_reference", named("cell", "cell_id"), "a gate names a record that is no decision", "b"))


def bindings(run: DataFrame) -> DataFrame:
    """(ak, named_output) of valid bindings of runs that succeeded at least in part."""
    each = run.where("status IN ('success', 'partial_success')").select("ak", F.explode("output_bindings").alias("b"))
    return each.where(F.coalesce(F.col("b.status"), F.lit("valid")) == "valid").select("ak", "b.named_output").distinct()


def named_outputs(ref: DataFrame, bound: DataFrame) -> DataFrame:
    """ref(ak, ref, kind, ident, sub), bound(ak, named_output)"""
    outputs = ref.where("kind = 'named_output'").withColumn("named_output", F.concat(F.lit("cell:"), "ident", F.lit("#"), "sub"))
    return diag(outputs.join(bound, ["ak", "named_output"], "left_anti"), "V1-05", "invalid_reference", F.col("ref"), "no valid run binding gives this output")


def stored_objects(ref: DataFrame, object_: DataFrame) -> DataFrame:
    """ref(ak, ref, kind, ident), object(ak, digest, flat, reachable, valid)"""
    chosen = object_.where("reachable").groupBy("ak", F.col("digest").alias("ident")).agg(F.max_by("valid", "flat").alias("valid"))
    wrong = ref.where("kind = 'object'").join(chosen.where(~F.col("valid")), ["ak", "ident"], "left_semi")
    corrupt = diag(wrong, "V1-07", "corrupt_object", F.col("ref"), "the stored bytes have another digest")
    return missing_objects(ref, object_, "V1-06", "a reachable object is not stored").unionByName(corrupt)
