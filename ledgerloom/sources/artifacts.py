"""Artifact directories to relations.

``load(spark, "corpus/*/artifact.dir")`` reads all artifacts that the globs match in two scans: one
of the JSON documents as whole texts, one of the stored objects. Every relation carries ``ak``, the
artifact's directory; artifacts share ids, so no rule joins without it. Of documents of a kind with
one id the last path wins. A document that is no JSON object is left out and listed in ``broken``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import refs

#: Directory to id field.
KINDS = {"cells": "cell_id", "records": "record_id", "actors": "actor_id", "runs": "run_id", "commits": "commit_id", "renders": "render_id"}
SINGLE = ("manifest", "execution_structure", "expected_diagnostics")

_CHANGE = "op string, target string, path string, value_ref string, cell_id string, proposal string"
SCHEMAS = {
    "manifest": "sol_version string, artifact_id string, required_features array<string>, current_commit string, execution struct<deterministic boolean>, authorization struct<permit_self_application boolean, protected_branches array<struct<branch string, required_capabilities array<string>, allowed_committers array<string>>>>, reproducibility_status string",
    "execution_structure": "type string, cells array<string>",
    "expected_diagnostics": "expected_rule_ids array<string>",
    "cells": "cell_id string, cell_type string, summary string, depends_on array<string>, anchors_record string, decision_ref string",
    "records": "record_id string, record_type string, summary string, created_by string, status struct<lifecycle string, staleness string, verification string>, status_transition struct<`from` string, to string, via string>, depends_on array<string>, supporting_evidence array<string>, based_on array<string>, candidates array<string>, selected string, decision_rule string, made_by string, external_ref struct<availability string>, target string, method string, result string, concordance struct<type string>, run_id string, reviewed_by string, changes array<struct<" + _CHANGE.replace(" string", ": string") + ">>",
    "actors": "actor_id string, autonomy_level string, capabilities array<string>",
    "runs": "run_id string, status string, source_commit string, result_commit string, cells_executed array<string>, output_bindings array<struct<named_output string, object_ref string, status string>>, dependency_hints array<struct<cell_id string, undeclared_reads array<string>>>",
    "commits": "commit_id string, branch string, author string, parents array<string>, changes array<struct<" + _CHANGE.replace(" string", ": string") + ">>, applied_proposals array<struct<proposal string, accepted_by array<string>>>",
    "renders": "render_id string, source_commit string, includes_records array<string>, stale_disclosures array<string>",
}


@dataclass
class Relations:
    """The normalized relations of a set of artifacts."""

    artifact: DataFrame  # ak
    manifest: DataFrame  # ak, present, and SCHEMAS; a row for every artifact
    structure: DataFrame  # ak, linear, cells (bare), body
    cell: DataFrame  # ak, id, body, and SCHEMAS
    record: DataFrame
    actor: DataFrame
    run: DataFrame
    commit: DataFrame  # also ``place``, the path that the id came first in
    render: DataFrame
    summary: DataFrame  # ak, body of renders/machine_summary.json
    object: DataFrame  # ak, digest, reachable (by its path), valid (its hash is its name), regular
    ref: DataFrame  # ak, ref, kind, ident, sub: distinct references anywhere in the documents
    expected: DataFrame  # ak, rule_id
    broken: DataFrame  # ak, path

    def persist(self) -> Relations:
        for f in fields(self):
            getattr(self, f.name).persist()
        return self

    def unpersist(self) -> None:
        for f in fields(self):
            getattr(self, f.name).unpersist()

    def save(self, path: str) -> None:
        """Write each relation as Parquet below ``path``; rules then prune columns."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Relations:
        return cls(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)))


def _existing(spark: SparkSession, globs: list[str]) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = []
    for g in globs:
        p = hadoop.Path(g)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
            out.append(g)
    return out


def strings(nodes: DataFrame) -> DataFrame:
    """Of (ak, v variant) all string values at any depth, as (ak, s). Keys are not values.

    One level of all documents at a time, so the number of jobs is the depth of the deepest one.
    """
    spark = nodes.sparkSession
    found, levels = None, []
    while True:
        nodes = nodes.withColumn("t", F.schema_of_variant("v")).persist()
        levels.append(nodes)
        here = nodes.where("t = 'STRING'").select("ak", F.variant_get("v", "$", "string").alias("s"))
        found = here if found is None else found.unionByName(here)
        inner = nodes.where("t LIKE 'OBJECT%' OR t LIKE 'ARRAY%'")
        if inner.isEmpty():
            break
        nodes = spark.sql("SELECT ak, x.value AS v FROM {inner}, LATERAL variant_explode({inner}.v) AS x", inner=inner.select("ak", "v"))
    return found


def references(values: DataFrame) -> DataFrame:
    """Of (ak, s) the distinct references (ak, ref, kind, ident, sub); kind is null for malformed ones."""
    distinct = values.where(refs.is_ref(F.col("s"))).select("ak", F.col("s").alias("ref")).distinct()
    return distinct.withColumn("p", refs.parse_ref(F.col("ref"))).select("ak", "ref", refs.kind_of(F.col("ref")).alias("kind"), "p.ident", "p.sub")


def _typed(docs: DataFrame, kind: str, *also: str | Column) -> DataFrame:
    return docs.where(F.col("kind") == kind).withColumn("j", F.from_json("text", SCHEMAS[kind])).select("ak", "id", "body", *also, "j.*")


def load(spark: SparkSession, *roots: str) -> Relations:
    roots = [r.rstrip("/") for r in roots]
    paths = _existing(spark, [f"{r}/{x}" for r in roots for x in ("*.json", *(f"{k}/*.json" for k in KINDS))])
    if not paths:
        raise FileNotFoundError(f"no artifact in {roots}")
    name = F.col("path")
    scan = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    parent = F.element_at(F.split(name, "/"), -2)
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.json$", "")
    nested = parent.isin(*KINDS)
    docs = scan.withColumns({"kind": F.when(nested, parent).otherwise(stem), "ak": F.regexp_replace(name, r"(/(" + "|".join(KINDS) + r"))?/[^/]+$", ""), "stem": stem})
    docs = docs.where(F.col("kind").isin(*KINDS, *SINGLE)).withColumn("body", F.try_parse_json("text"))
    ok = F.coalesce(F.schema_of_variant("body").startswith("OBJECT"), F.lit(False))
    id_field = F.coalesce(*(F.when(F.col("kind") == k, F.try_variant_get("body", f"$.{f}", "string")) for k, f in KINDS.items()))
    docs = docs.withColumns({"ok": ok, "id": F.coalesce(id_field, F.col("stem"))}).persist()
    good = docs.where("ok")
    last = good.groupBy("ak", "kind", "id").agg(F.max("path").alias("path"), F.min("path").alias("place"))
    good = good.join(last, ["ak", "kind", "id", "path"]).persist()

    artifact = docs.select("ak").distinct()
    manifest = artifact.join(_typed(good, "manifest").withColumn("present", F.to_json("body") != "{}").drop("id"), "ak", "left")
    structure = _typed(good, "execution_structure").withColumn("linear", F.when(F.variant_get("body", "$.type", "variant").isNull(), True).otherwise(F.coalesce(F.col("type") == "linear", F.lit(False))))
    structure = structure.select("ak", "linear", F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: refs.bare_id(c, "cell")).alias("cells"), "body")
    has = lambda key: F.variant_get("body", f"$.{key}", "variant").isNotNull()
    record = _typed(good, "records").withColumns({
        "filled": F.to_json("body") != "{}",
        "external": has("external_ref") & ~F.to_json(F.variant_get("body", "$.external_ref", "variant")).isin("{}", "null", '""'),
        "has_availability": has("external_ref.availability"),
        "has_concordance": has("concordance") & ~F.to_json(F.variant_get("body", "$.concordance", "variant")).isin("{}", "null", '""'),
    })
    objects = _existing(spark, [f"{r}/objects/sha256" for r in roots])
    if objects:
        blob = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(objects).select(F.col("_metadata.file_path").alias("path"), "content")
        rest = F.regexp_extract("path", r"/objects/sha256/(.*)$", 1)
        digest = F.element_at(F.split(rest, "/"), -1)
        deep = F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)
        object_ = blob.select(F.regexp_replace("path", r"/objects/sha256/.*$", "").alias("ak"), digest.alias("digest"), (rest == digest).alias("flat"), ((rest == digest) | (rest == deep)).alias("reachable"), (F.sha2("content", 256) == digest).alias("valid"))
    else:
        object_ = spark.createDataFrame([], "ak string, digest string, flat boolean, reachable boolean, valid boolean")
    values = strings(good.where("kind <> 'expected_diagnostics'").select("ak", F.col("body").alias("v")))
    out = Relations(
        artifact=artifact,
        manifest=manifest.withColumn("present", F.coalesce("present", F.lit(False))),
        structure=structure,
        cell=_typed(good, "cells").withColumn("duplicates", has("statement") | has("canonical_content") | has("content")),
        record=record,
        actor=_typed(good, "actors"),
        run=_typed(good, "runs"),
        commit=_typed(good, "commits", "place"),
        render=_typed(good, "renders"),
        summary=docs.where("kind = 'renders' AND stem = 'machine_summary' AND ok").select("ak", "body"),
        object=object_,
        ref=references(values),
        expected=_typed(good, "expected_diagnostics").select("ak", F.explode("expected_rule_ids").alias("rule_id")),
        broken=docs.where("NOT ok").select("ak", "path"),
    )
    return out
