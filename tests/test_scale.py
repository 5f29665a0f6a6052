"""What the rules cost by the row: plans and results that hold at any size."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import refs
from ledgerloom.operators import v1, v2, v3, v4
from ledgerloom.plans import testbed
from ledgerloom.sources.artifacts import references

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cycles_of_many_artifacts_take_one_pass(spark):
    """Artifacts are not handed to Python one by one, and may reach over batches."""
    rows = [(f"a{i}", f"c{j}", f"{j:03}", [f"commit:c{(j + 1) % 7 if i % 3 == 0 else j + 1}", "gone"]) for i in range(50) for j in range(7)]
    rows += [(None, "x", "2", ["x"]), (None, "y", None, None), ("b", "p", "1", [None, "q"]), ("b", "q", "2", ["commit:p", "q"])]
    commit = spark.createDataFrame(rows, "ak string, id string, place string, parents array<string>").repartition(8, "place")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = v1.commit_cycles(commit)
        got = sorted(((r.ak, r.target) for r in found.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(f"a{i}", "commit:c0") for i in range(0, 50, 3)] + [(None, "commit:x"), ("b", "commit:p"), ("b", "commit:q")]
    assert got == sorted(want, key=repr)
    assert "FlatMapGroups" not in plan(found)


def test_committers_are_joined_not_searched(spark):
    """The last entry of a branch counts, null ones too, and no commit goes through the list of committers."""
    entry = "struct<branch string, required_capabilities array<string>, allowed_committers array<string>>"
    manifest = spark.createDataFrame([
        ("a", ([("main", ["fly"], ["ann", "bob"]), ("main", ["commit"], ["bob", None]), (None, ["commit"], None), ("free", None, []), None],)),
        ("b", ([("main", ["commit", "fly"], ["ann"])],)), ("c", (None,)), ("d", None),
    ], f"ak string, authorization struct<protected_branches array<{entry}>>")
    commits = [(ak, f"{ak}{b}{w}", b, w, ["read"] + (["commit"] if w == "eve" else [])) for ak in "abcd" for b in ("main", "free", None) for w in ("ann", "bob", "eve", None)]
    capable = spark.createDataFrame(commits, "ak string, commit_id string, branch string, author string, caps array<string>")
    found = v4.protected_branches(capable, manifest)
    assert sorted(r.target for r in found.collect()) == sorted("commit:" + c for c in ("amainann", "amainNone", "bmainbob", "bmaineve", "bmainNone"))
    assert "array_contains" not in plan(found)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", ["partial_failure", "undeclared_read", "named_output", "proposal_match"])
def test_lines_are_not_collected(spark, name):
    assert "collect_list" not in plan(testbed.QUERIES[name](spark, DIR))


def test_bindings_of_a_run_in_several_rows(spark):
    runs = [("a", "r", "partial_success", ["cell:x"], ["cell:x#o", None]), ("a", "r", "partial_success", ["cell:x"], ["cell:y#o"]), ("a", "s", "success", [], ["cell:y#o"]), ("a", "t", "partial_success", None, ["cell:y#o"]), ("a", None, "partial_success", ["cell:x"], None)]
    run = spark.createDataFrame(runs, "ak string, run_id string, status string, cells_executed array<string>, names array<string>").withColumn("output_bindings", F.expr("transform(names, n -> named_struct('named_output', n))"))
    record = spark.createDataFrame([("a", "sol:record/failure", "run:r"), ("b", "sol:record/failure", "run:t")], "ak string, record_type string, run_id string")
    assert sorted(r.target for r in v2.overbound(run).collect()) == ["run:r", "run:t"]
    assert {r.target for r in v2.unpaired(run, record).collect()} == {"run:t", "run:<unknown>"}


def test_filters_by_kind_take_no_reference_apart(spark):
    texts = ["cell:a#b", "cell:a#b\n", "cell:a#b\n\n", "cell:a", "cell:a#", "cell:", "cell", "xcell:a", "\ncell:a", "record:x", "run:1 ", "commit:c", "branch:b", "render:r", "sol://a/b/c", "sol://a/b", "object:sha256:" + "a" * 64, "object:sha256:" + "A" * 64, "digest:sha256:" + "0" * 64, "digest:x", "", None]
    df = spark.createDataFrame([("a", x) for x in texts], "ak string, s string")
    both = df.select("s", refs.is_ref(F.col("s")).alias("is"), refs.kind_of(F.col("s")).alias("kind"), refs.parse_ref(F.col("s"))["kind"].alias("want")).collect()
    assert [r.kind for r in both] == [r.want for r in both]
    assert [r["is"] for r in both] == [None if r.s is None else r.s.startswith(refs.PREFIXES) for r in both]
    found = references(df).where("kind = 'named_output'")
    assert {(r.ref, r.ident, r.sub) for r in found.collect()} == {("cell:a#b", "a", "b"), ("cell:a#b\n", "a", "b")}
    assert not any("regexp_extract" in line for line in plan(references(df).where("kind = 'named_output'")).splitlines() if "Filter" in line)


def test_changes_in_several_rows_and_one_review_of_many(spark):
    change = "struct<op string, target string, path string, value_ref string, cell_id string, proposal string>"
    edit = lambda target, path=None: ("modify_cell", target, path, None, None, None)
    apply_ = lambda p: ("apply_proposal", None, None, None, None, p)
    app = lambda p, *by: (p, list(by))
    commits = [
        ("a", "1", "1", [apply_("record:p"), None], [app("record:p", "record:v")]), ("a", "2", "2", [apply_("p"), edit("x")], [app("p", "record:gone", "v")]), ("a", "3", "3", [apply_(None), apply_("record:no")], None),
        ("a", "4", "4", [apply_("record:q"), apply_("record:p")], [app("record:q", None)]), ("b", "1", "1", [apply_("record:p")], [app("record:p", "record:v")]), ("a", "5", "5", None, None),
    ]
    commit = spark.createDataFrame(commits, f"ak string, id string, commit_id string, changes array<{change}>, applied_proposals array<struct<proposal string, accepted_by array<string>>>")
    records = [("a", "p", True, [edit("x")]), ("a", "p", True, [edit("y", "z")]), ("a", "q", True, [None]), ("a", "v", True, None), ("b", "v", True, None), ("b", "p", False, [edit("x")])]
    record = spark.createDataFrame(records, f"ak string, id string, filled boolean, changes array<{change}>")
    changed = spark.createDataFrame([("a", "1", [edit("x")]), ("a", "1", [edit("y", "z"), None]), ("a", "2", [edit("y")]), ("a", "4", [edit("x"), edit("y", "z")])], f"ak string, id string, changes array<{change}>")
    once = spark.createDataFrame([r[:3] for r in records if r[3] != [edit("y", "z")]], "ak string, id string, filled boolean")
    found = v3.unaccepted(commit, once)
    assert {(r.ak, r.part, r.target[7:]) for r in found.collect()} == {("a", "c", "2"), ("a", "a", "3"), ("a", "b", "4"), ("a", "c", "4"), ("b", "a", "1")}
    assert {(r.ak, r.part, r.target[7:]) for r in v3.lacking(commit, record, changed).collect()} == {("a", "d", "2"), ("a", "d", "4")}
