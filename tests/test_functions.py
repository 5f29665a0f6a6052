from pyspark.sql import functions as F

from ledgerloom.functions import docs, refs
from ledgerloom.operators.base import cell_key, records_of_type


def test_parse_ref(spark):
    h = "a" * 64
    cases = {
        f"object:sha256:{h}": ("object", h, None), f"object:sha256:{h}\n": ("object", h, None), f"object:sha256:{h}\r": None, f"object:sha256:{h.upper()}": None, f"digest:sha256:{h}": ("digest", h, None),
        "cell:a#b": ("named_output", "a", "b"), "cell:a:b-c_9": ("cell", "a:b-c_9", None), "cell:a#": None, "record:x": ("record", "x", None), "record:": None, "run:1": ("run", "1", None), "commit:c": ("commit", "c", None),
        "branch:main": ("branch", "main", None), "render:r": ("render", "r", None), "sol://a/b/c/d": ("sol_uri", "a", "b/c/d"), "sol://a/b": None, "é": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "r string").withColumn("p", refs.parse_ref(F.col("r"))).collect()
    assert {r.r: None if r.p is None else tuple(r.p) for r in rows} == cases


def test_small_functions(spark):
    r = spark.range(1).select(
        refs.bare_id(F.lit("cell:a:b"), "cell").alias("a"), refs.bare_id(F.lit("b"), "cell").alias("b"), refs.object_ref(F.lit("x")).alias("o"), refs.digest_ref(F.lit("x")).alias("d"),
        docs.canonical(F.lit('{"b": [1, "é"], "a": null}')).alias("j"), docs.canonical(F.lit("{")).alias("bad"), docs.blank(F.lit(None).cast("string")).alias("n"), docs.staleish(F.lit(None), F.lit("failed_verification")).alias("s"),
    ).first()
    assert (r.a, r.b, r.j, r.bad, r.n, r.s) == ("a:b", "b", '{"a":null,"b":[1,"é"]}', None, True, True)
    assert r.o == "object:" + r.d.removeprefix("digest:")


def test_accessors(spark):
    r = spark.createDataFrame([("cell:a#out", "sol:record/claim"), ("b#x", "sol:record/review"), ("c", None)], "c string, record_type string")
    assert [x.k for x in r.select(cell_key(F.col("c")).alias("k")).collect()] == ["a", "b", "c"]
    assert [x.c for x in records_of_type(r, "review").collect()] == ["b#x"]
